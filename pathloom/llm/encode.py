"""Token ids of whole texts by the tokenizers library, each distinct word of a batch being encoded once."""

from __future__ import annotations

import itertools
import json
import os
import re
import sys
from array import array

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

DEFAULT_VOCABULARY = "byte_bpe_50k.json"
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ɏ", r"!-&(-/:-@\[-`{-~"


def vocabulary_path(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Encodes texts to unsigned 32-bit ids, equal to the library's own encoding of the whole text.

    A byte-level BPE vocabulary with the usual pattern merges nothing across a space that stands before a visible character,
    nor between letters, signs and new lines. So a batch falls into words, its distinct words are encoded, and the ids of all
    texts are gathered from theirs. Words seen early stay in a cache of a fixed number of entries. Texts that hold an
    added token's string, and vocabularies of another kind, go to the library as a whole.
    """

    def __init__(self, path: str, entries: int = 200_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        kind = {n: json.loads(part.__getstate__()) if (part := getattr(self.tokenizer, n)) else None for n in ("normalizer", "pre_tokenizer", "post_processor")}
        pre = kind["pre_tokenizer"] or {}
        usual = type(self.tokenizer.model).__name__ == "BPE" and pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
        self.by_word = bool(usual) and sys.byteorder == "little" and array("I").itemsize == 4 and not kind["normalizer"] and not kind["post_processor"]
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.entries = entries
        self.cache: dict[str, bytes | None] = {}
        # The byte-level alphabet: visible bytes stand for themselves, the others for the characters from 256 on, in order.
        seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
        hidden = [b for b in range(256) if b not in seen]
        self.alphabet = {b: chr(b) for b in seen} | {b: chr(256 + k) for k, b in enumerate(hidden)}
        self.safe = re.compile("[!-~À-ɏ]")
        self.parts = re.compile(f"([{_LETTERS}]+)([{_SIGNS}]*)(?:\\n([{_LETTERS}]+)([{_SIGNS}]*))?\\Z")
        self.bare: dict[str, bytes] = {}

    def _library(self, texts: list[str]) -> list[bytes]:
        encode = getattr(self.tokenizer, "encode_batch_fast", self.tokenizer.encode_batch)
        return [np.array(x.ids, dtype="<u4").tobytes() for x in encode(texts, add_special_tokens=False)] if texts else []

    def _stretches(self, texts: list[str]) -> list[bytes]:
        """Of texts without new lines that are one stretch of the pattern each: the model alone encodes them."""
        if not texts:
            return []
        written = "\n".join(texts).encode().decode("latin-1").translate(self.alphabet).split(self.alphabet[10])
        tokenize = self.tokenizer.model.tokenize
        return [array("I", [t.id for t in tokenize(w)]).tobytes() for w in written]

    def _without_space(self, words: set[str]) -> None:
        """Fills the cache of words, or runs of signs, that no space precedes."""
        if len(self.bare) > self.entries // 4:
            self.bare = {}
        new = [w for w in words if w not in self.bare]
        plain = [w for w in new if re.fullmatch(f"[{_LETTERS}]+|[{_SIGNS}]+", w)]
        self.bare.update(zip(plain, self._stretches(plain)))
        rest = [w for w in new if w not in self.bare]
        self.bare.update(zip(rest, self._library(rest)))

    def _with_space(self, words: list[str]) -> list[bytes | None]:
        """Of distinct words that a space precedes; None where there is no sure boundary before that space."""
        cache, parts = self.cache, self.parts.match
        out = [cache.get(w, False) for w in words]
        new = [w for w, x in zip(words, out) if x is False]
        if not new:
            return out
        plain = pc.match_substring_regex(pa.array(new, type=pa.large_string()), f"^[{_LETTERS}]+$").to_numpy(zero_copy_only=False)
        letters, joined, odd, bare = [w for w, x in zip(new, plain.tolist()) if x], [], [], {"\n"}
        single = set(letters)
        for k in np.flatnonzero(~plain).tolist():
            w = new[k]
            m = parts(w)
            if m is None:
                odd.append(w)
            else:
                groups = m.groups("")
                joined.append((w, groups))
                if groups[0] not in cache:
                    single.add(groups[0])
                bare.update(groups[1:])
        letters += single.difference(letters)
        fresh: dict[str, bytes | None] = dict(zip(letters, self._stretches([" " + w for w in letters])))
        self._without_space(bare)
        known, end = self.bare, self.bare["\n"]
        for w, (a, b, c, d) in joined:
            first = fresh[a] if a in fresh else cache[a]
            fresh[w] = first + known[b] + end + known[c] + known[d] if c else first + known[b]
        sure = [w for w in odd if self.safe.match(w)]
        fresh.update(dict.fromkeys(odd))
        fresh.update(zip(sure, self._library([" " + w for w in sure])))
        # Words seen early stay: they are mostly the frequent ones.
        cache.update(itertools.islice(fresh.items(), max(0, self.entries - len(cache))))
        return [fresh[w] if x is False else x for w, x in zip(words, out)]

    def _by_chunks(self, text: str) -> bytes:
        """Of a text where some spaces are no sure boundary."""
        if any(a in text for a in self.added):
            return self._library([text])[0]
        first, *words = text.split(" ")
        chunks = [first]
        for w in words:
            if self.safe.match(w):
                chunks.append(" " + w)
            else:
                chunks[-1] += " " + w
        distinct = list({c for c in chunks if c})
        ids = dict(zip(distinct, self._library(distinct)))
        return b"".join([ids[c] for c in chunks if c])

    def encode_column(self, texts: pa.Array) -> list[np.ndarray]:
        """The ids of each text of a column without nulls."""
        if not self.by_word:
            return [np.frombuffer(x, dtype="<u4") for x in self._library(texts.to_pylist())]
        if not len(texts):
            return []
        split = pc.split_pattern(texts.cast(pa.large_string()), " ")
        starts = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        distinct, index = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int32)
        ids = self._with_space(distinct)
        heads = index[starts[:-1]]
        first = np.unique(heads)
        self._without_space({distinct[k] for k in first.tolist()})
        unsure = np.array([x is None for x in ids], dtype=bool)
        table = [x or b"" for x in ids] + [self.bare[distinct[k]] for k in first.tolist()]
        is_head = np.zeros(len(index), dtype=bool)
        is_head[starts[:-1]] = True
        later = np.add.reduceat((unsure[index] & ~is_head).astype(np.int32), starts[:-1]) > 0
        for a in self.added:
            later |= pc.match_substring(texts, a).to_numpy(zero_copy_only=False)
        index[starts[:-1]] = len(distinct) + np.searchsorted(first, heads)
        sizes = np.fromiter(map(len, table), dtype=np.int64, count=len(table)) // 4
        flat, at = np.frombuffer(b"".join(table), dtype="<u4"), np.cumsum(sizes) - sizes
        each = sizes[index]
        ends = np.cumsum(each)
        small = np.int32 if max(ends[-1], len(flat)) < 1 << 31 else np.int64
        place = np.repeat((at[index] - (ends - each)).astype(small), each)
        place += np.arange(ends[-1], dtype=small)
        gathered = flat[place]
        bounds = np.concatenate([[0], ends[starts[1:] - 1]])
        out = [gathered[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]
        for k in np.flatnonzero(later).tolist():
            out[k] = np.frombuffer(self._by_chunks(texts[k].as_py()), dtype="<u4")
        return out


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """One for each path in a worker process."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]
