"""Token ids of whole texts through the ``tokenizers`` library, word by word with a bounded memory of words.

The word tokenizer drops white space and never forms a token across it, so the ids of a text are those of its
white-space separated words, one after another. Words repeat, so a worker remembers the ids of up to
``CACHE_WORDS`` of them; the rest are encoded again in each batch they occur in, and the result is the same.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from itertools import islice

import numpy as np
from tokenizers import Tokenizer, normalizers, pre_tokenizers

CACHE_WORDS = 150_000
#: Bytes of text that are worked on together.
CHUNK_BYTES = 2_000_000
#: Texts, and words by themselves, that the library encodes at a time: what it returns takes some hundred bytes a token, the ids two or four.
ENCODED, ENCODED_WORDS = 16, 4000
#: By line: lower-cased latin letters, perhaps with marks after them, else two empty groups. The library's normaliser
#: keeps such words as they are, and its pattern splits just before the marks.
_LINES = re.compile(r"(?m)^(?:([a-zß-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)|.*)$")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class _Codes(dict):
    """Numbers words in the order in which they come up."""

    def __missing__(self, word: bytes) -> int:
        self[word] = code = len(self)
        return code


class WordEncoder:
    """``ids(texts)`` gives one array of ids per text, equal to ``encode(text, add_special_tokens=False).ids``."""

    def __init__(self, path: str):
        self.full = Tokenizer.from_file(path)
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        vocab = self.full.get_vocab(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if max(vocab.values()) < 1 << 16 else "<u4")
        self.ends = np.zeros(max(vocab.values()) + 1, bool)
        self.ends[[i for token, i in vocab.items() if token.endswith("</w>")]] = True
        self.codes = _Codes()
        self.flat = np.empty(0, self.dtype)
        self.starts = np.empty(0, np.int64)  # the ids of word c are flat[starts[c] : starts[c] + lengths[c]]
        self.lengths = np.empty(0, np.int64)

    def _each(self, tokenizer: Tokenizer, texts: list[str], at_once: int = ENCODED) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = []
        for i in range(0, len(texts), at_once):
            out += [np.array(e.ids, self.dtype) for e in tokenizer.encode_batch_fast(texts[i : i + at_once], add_special_tokens=False)]
        return out

    def _encode(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, and where those of each word start and how many they are."""
        found = _LINES.findall(b"\n".join(words).decode("utf-8").lower())
        if len(found) != len(words):  # lower-casing has made no new lines, but be safe
            found = [("", "")] * len(words)
        is_plain = np.fromiter((bool(a) for a, _ in found), bool, len(words))
        starts, lengths = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        flat = np.empty(0, self.dtype)
        if is_plain.any():
            parts = [f"{a} {b}" if b else a for a, b in found if a]
            flat = np.concatenate(self._each(self.plain, [" ".join(parts[i : i + 2000]) for i in range(0, len(parts), 2000)]))
            # Each part ends with the one token that closes a word, so the flat ids fall apart at those.
            closes = np.flatnonzero(self.ends[flat]) + 1
            stops = closes[np.cumsum([1 + bool(b) for a, b in found if a]) - 1]
            starts[is_plain], lengths[is_plain] = np.concatenate([[0], stops[:-1]]), np.diff(stops, prepend=0)
        if not is_plain.all():
            rest = self._each(self.full, [w.decode("utf-8") for w, p in zip(words, is_plain.tolist()) if not p], ENCODED_WORDS)
            sizes = np.array([len(x) for x in rest])
            starts[~is_plain], lengths[~is_plain] = len(flat) + np.cumsum(sizes) - sizes, sizes
            flat = np.concatenate([flat, *rest])
        return flat, starts, lengths

    def ids(self, texts: list[bytes]) -> list[np.ndarray]:
        before = len(self.codes)
        code = self.codes.__getitem__
        # Lower case at once where it cannot make a special token of ordinary text: fewer words to tell apart.
        split = [t.split() if b"<|" in t else t.lower().split() for t in texts]
        sizes = [len(words) for words in split]
        codes = np.fromiter((c for words in split for c in map(code, words)), np.int64, sum(sizes))
        del split
        known = len(self.flat)
        if len(self.codes) > before:
            flat, starts, lengths = self._encode(_last(self.codes, len(self.codes) - before))
            self.flat = np.concatenate([self.flat, flat])
            self.starts = np.concatenate([self.starts, starts + known])
            self.lengths = np.concatenate([self.lengths, lengths])
        starts, lengths = self.starts[codes], self.lengths[codes]
        ends = np.cumsum(lengths)
        out = self.flat[_ranges(starts, lengths)]
        cuts = np.concatenate([[0], ends])[np.cumsum(sizes)] if sizes else np.empty(0, np.int64)
        result = np.split(out, cuts[:-1]) if sizes else []
        if len(self.codes) > CACHE_WORDS:
            keep = max(before, CACHE_WORDS)
            for word in _last(self.codes, len(self.codes) - keep):
                del self.codes[word]
            new = self.flat[_ranges(self.starts[before:keep], self.lengths[before:keep])]
            self.flat = np.concatenate([self.flat[:known], new])
            self.lengths = self.lengths[:keep].copy()
            self.starts = np.concatenate([self.starts[:before], known + np.cumsum(self.lengths[before:]) - self.lengths[before:]])
        return result


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The indexes of all the ranges, one after another."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def _last(d: dict, n: int) -> list:
    """The last n keys, in the order of their insertion."""
    return list(islice(reversed(d), n))[::-1]


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """One encoder per worker process and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def chunks(batches: Iterator, text: str = "text") -> Iterator[tuple[dict[str, list], list[bytes]]]:
    """Arrow batches gathered into chunks of about CHUNK_BYTES: the other columns as lists, and the texts."""
    held: dict[str, list] = {}
    texts: list[bytes] = []
    size = 0
    for batch in batches:
        names = [n for n in batch.schema.names if n != text]
        rows = {n: batch.column(n).to_pylist() for n in names}
        for i, value in enumerate(batch.column(text).to_pylist()):
            for n in names:
                held.setdefault(n, []).append(rows[n][i])
            texts.append(value or b"")
            size += len(texts[-1])
            if size >= CHUNK_BYTES:
                yield held, texts
                held, texts, size = {}, [], 0
    if texts:
        yield held, texts
