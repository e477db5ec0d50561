"""Token ids of texts by a public byte-level BPE, with a bounded memo of chunks.

The tokenizer's pattern splits a text into white space and words with at most one space before them,
and encodes each piece by itself. So a text may be cut before any space or newline that a character
other than white space follows, without changing its ids. Chunks cut so are encoded by the library
once and kept packed as bytes while the memo has room; a text is then one split, look-ups and a join.
Texts with longer runs of white space, or where a chunk begins with a character that pattern engines
may class differently, and texts in which the string of an added token occurs, go to the library whole.
`encode_all` does this for an Arrow array: texts are cut and their distinct chunks found by Arrow, a chunk
is looked up or encoded once an array, and ids are laid in the order of the texts by one `take`.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Characters that every pattern engine takes for letters, digits, marks or signs, never for white space.
_PLAIN = re.compile("[!-~¡-¬®-ɏΑ-ΡΣ-ωА-я–—‘-„…€一-龥]")
#: A part that begins so, after its newline if it has one.
_PLAIN_PART = f"^\n?{_PLAIN.pattern}"
_LETTERS = re.compile("[A-Za-zÀ-ÖØ-öø-ɏΑ-ΡΣ-ωА-я]+")
#: ASCII signs; the apostrophe is none here, as the pattern knows 's, 't and others.
_SIGNS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
_CACHE: dict = {}


def byte_alphabet() -> dict[int, int]:
    """The printable character that stands for each byte in byte-level vocabularies: itself, or one from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return dict(zip(shown, shown)) | {b: 256 + i for i, b in enumerate(hidden)}


class PackedEncoder:
    """Encodes texts to packed little-endian ids. memo: most chunks that are kept (about 150 bytes each)."""

    def __init__(self, name: str = "byte_bpe_50k.json", memo: int = 250_000, dtype: str = "<u2"):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        import public_tokenizers
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(name if os.path.isabs(name) else public_tokenizers.path(name))
        self.added = tuple(t.content for t in self.tokenizer.get_added_tokens_decoder().values())
        self.dtype = dtype if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4"
        self.width = np.dtype(self.dtype).itemsize
        self.model = self.tokenizer.model
        self.code = "H" if self.width == 2 else "I"
        self.alphabet = byte_alphabet()
        self.space = chr(self.alphabet[32])
        self.line = self.whole("\n")
        self.memo: dict[str, bytes] = {}
        self.tails: dict[str, bytes] = {}
        self.numbers: dict[str, int] = {}
        self.most = memo

    @classmethod
    def shared(cls, name: str) -> PackedEncoder:
        """One encoder a worker process."""
        if name not in _CACHE:
            _CACHE[name] = cls(name)
        return _CACHE[name]

    def whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, self.dtype).tobytes()

    def _has_added(self, text: str) -> bool:
        return any(t in text for t in self.added)

    def encode(self, text: str) -> bytes:
        if self._has_added(text):
            return self.whole(text)
        memo = self.memo
        # a part stands for itself with the space before it, or begins with its newline
        first, *parts = text.replace("\n", " \n").split(" ")
        try:
            return self.whole(first) + b"".join([memo[p] for p in parts])
        except KeyError:
            new = [p for p in dict.fromkeys(parts) if p not in memo]
        found, unknown = {}, {}
        for p in new:
            if not _PLAIN.match(p, 1 if p[:1] == "\n" else 0):
                return self.whole(text)
            # a word and the signs after it are pieces of their own, wherever the space is
            word = p.rstrip(_SIGNS)
            if not _LETTERS.match(word[-1:]):
                word = p
            unknown.setdefault(word, []).append(p)
        for word in [w for w in unknown if w in memo]:
            for p in unknown.pop(word):
                found[p] = memo[word] + self.signs(p[len(word) :])
        for word, whole in unknown.items():
            raw = self.chunk(word)
            if len(memo) < self.most:
                memo[word] = raw
            for p in whole:
                found[p] = raw + self.signs(p[len(word) :]) if p != word else raw
        return self.whole(first) + b"".join([memo[p] if p in memo else found[p] for p in parts])

    def encode_all(self, texts: pa.Array) -> list[bytes]:
        """encode() of each text of an array without nulls."""
        if not len(texts):
            return []
        cut = pc.split_pattern(pc.replace_substring(texts, "\n", " \n"), " ")
        bounds, coded = cut.offsets.to_numpy() - cut.offsets[0].as_py(), pc.dictionary_encode(cut.flatten())
        starts, at, parts = bounds[:-1], coded.indices.to_numpy().copy(), coded.dictionary
        firsts = pc.take(parts, pa.array(at[starts])).to_pylist()
        # each text's first part has no space before it, so it stands behind the parts as a value of its own
        at[starts] = len(parts) + np.arange(len(texts))
        odd = np.concatenate([pc.invert(pc.match_substring_regex(parts, _PLAIN_PART)).to_numpy(zero_copy_only=False), np.zeros(len(texts), bool)])
        alone = np.logical_or.reduceat(odd[at], starts)
        for t in self.added:
            alone |= pc.match_substring(texts, t).to_numpy(zero_copy_only=False)
        used = at if not alone.any() else at[np.repeat(~alone, np.diff(bounds))]
        times = np.bincount(used, minlength=len(odd))[: len(parts)]
        names = pc.binary_join(pa.ListArray.from_arrays(pa.array([0, len(parts)], pa.int32()), parts), " ")[0].as_py().split(" ")
        memo = self.memo
        raws = [*map(memo.get, names)]
        for i in np.flatnonzero(times).tolist():
            if raws[i] is None:
                raws[i] = raw = self.part(names[i])
                # those met once have half the room
                if len(memo) < (self.most if times[i] > 1 else self.most // 2):
                    memo[names[i]] = raw
        raws = [r or b"" for r in raws] + [b"" if x else self.letters(f, "") if f.isascii() and f.isalpha() else self.whole(f) for f, x in zip(firsts, alone.tolist())]
        ids = pc.take(pa.array(raws, pa.large_binary()), pa.array(at))
        ends = np.frombuffer(ids.buffers()[1], np.int64)[: len(at) + 1]
        packed, cuts = memoryview(ids.buffers()[2] or b""), ends[bounds].tolist()
        return [self.whole(texts[i].as_py()) if x else bytes(packed[a:b]) for i, (x, a, b) in enumerate(zip(alone.tolist(), cuts, cuts[1:]))]

    def part(self, p: str) -> bytes:
        """The ids of a part that begins with a plain character, after its newline if it has one."""
        if p.isascii() and p.isalpha():
            return self.letters(p, self.space)
        word = p.rstrip(_SIGNS)
        if word == p or not _LETTERS.match(word[-1:]):
            return self.chunk(p)
        if (raw := self.memo.get(word)) is None:
            raw = self.chunk(word)
            if len(self.memo) < self.most // 2:
                self.memo[word] = raw
        return raw + self.signs(p[len(word) :])

    def letters(self, word: str, before: str) -> bytes:
        """The ids of letters, which are one piece with the space before them: the model takes it as it is, in the byte alphabet."""
        piece = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
        return array(self.code, [t.id for t in self.model.tokenize(before + piece)]).tobytes()

    def chunk(self, word: str) -> bytes:
        """The ids of a part with its space or newline."""
        if word[0] == "\n":
            return self.line + self.letters(word[1:], "") if _LETTERS.fullmatch(word, 1) else self.whole(word)
        return self.letters(word, self.space) if _LETTERS.fullmatch(word) else self.whole(" " + word)

    def signs(self, tail: str) -> bytes:
        if tail not in self.tails:
            if len(self.tails) > 10_000:
                self.tails.clear()
            self.tails[tail] = self.whole(tail) if tail else b""
        return self.tails[tail]

    def count(self, text: str) -> int:
        """The number of ids. Numbers of chunks are kept in a memo of their own, which is smaller than that of ids."""
        if self._has_added(text):
            return len(self.whole(text)) // self.width
        memo = self.numbers
        first, *parts = text.replace("\n", " \n").split(" ")
        try:
            return len(self.whole(first)) // self.width + sum([memo[p] for p in parts])
        except KeyError:
            new = [p for p in dict.fromkeys(parts) if p not in memo]
        found = {}
        for p in new:
            if not _PLAIN.match(p, 1 if p[:1] == "\n" else 0):
                return len(self.whole(text)) // self.width
            word = p.rstrip(_SIGNS)
            if not _LETTERS.match(word[-1:]):
                word = p
            if (n := memo.get(word, found.get(word))) is None:
                n = len(self.chunk(word)) // self.width
                if len(memo) < self.most:
                    memo[word] = n
            found[p] = n + len(self.signs(p[len(word) :])) // self.width if p != word else n
        return len(self.whole(first)) // self.width + sum([memo[p] if p in memo else found[p] for p in parts])
