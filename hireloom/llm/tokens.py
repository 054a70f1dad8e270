"""Token ids of texts by a public tokenizer file, inside Spark tasks."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from ._shared import give_back

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
os.environ.setdefault("RAYON_NUM_THREADS", "1")

#: Letters whose lower case and normal form are one plain letter in every Unicode version.
_LETTERS = "A-Za-zÀ-ÖØ-öø-įıĲ-ňŊ-ſ"
#: Such a word: its letters, and the marks that close it.
_PLAIN = rf"^(?P<core>[{_LETTERS}]+)(?P<marks>[.,;:!?%$&#*|()\[\]\"\-]*)$"

_ENCODERS: dict[str, "WordEncoder"] = {}


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encoder(path: str) -> "WordEncoder":
    """The encoder of this Python worker; its memo serves all tasks the worker runs."""
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
        give_back()  # what reading the file took, 60 MB of each worker
    return _ENCODERS[path]


def splits_on_space(spec: dict) -> bool:
    """Whether no token of this tokenizer reaches over white space, so words encode one by one."""
    steps = spec.get("normalizer") or {}
    for step in steps.get("normalizers", [steps] if steps else []):
        spaces = step["type"] == "Replace" and step["pattern"].get("Regex") == r"\s+" and step["content"] == " "
        if not spaces and step["type"] not in ("NFC", "Lowercase"):
            return False
    pre = spec.get("pre_tokenizer") or {}
    first = (pre.get("pretokenizers") or [pre])[0]
    if not (first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")):
        return False
    import regex

    own = regex.compile(first["pattern"].get("Regex", ""))
    return not any(own.search(s) for s in (" ", "\n", "\t", "\r", "\x0b", "\x0c")) and not any(
        re.search(r"\s", t["content"]) or t.get("lstrip") or t.get("rstrip") for t in spec.get("added_tokens", [])
    )


def byte_letters() -> dict[int, str]:
    """Byte-level BPE's letter of each byte: printable ones stand for themselves, the rest from code point 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


def _bytes_of(values: pa.Array) -> np.ndarray:
    return values.cast(pa.binary()).to_numpy(zero_copy_only=False)


class WordEncoder:
    """Encodes with the tokenizers library, each distinct word once.

    Words of a text repeat, and a tokenizer that drops white space encodes a
    text to the ids of its words one after the other. So the distinct words of
    a slice of texts are looked up in a memo of bounded size, and the library
    sees those that this worker doesn't remember. A word of plain letters and
    closing marks is two pre-tokens at most, which go straight to the library's
    BPE model and share their entries with other spellings of the word. Other
    tokenizers get whole texts.
    """

    #: Words of a memo's newer half; when it is full it becomes the older half.
    WORDS, CORES = 200_000, 200_000
    #: Bytes of the texts that are split into words at once, or one longer text.
    SLICE = 1 << 19

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.tokenizer = Tokenizer.from_file(path)
        self.by_word = splits_on_space(spec)
        self.size = max(self.tokenizer.get_vocab(with_added_tokens=True).values()) + 1
        #: Type of the ids in the memo and of `encode`.
        self.dtype = np.dtype("<u2" if self.size <= 1 << 16 else "<u4")
        kinds = [p["type"] for p in (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])]
        vocab, suffix = self.tokenizer.get_vocab(with_added_tokens=False), spec["model"].get("end_of_word_suffix")
        letters = byte_letters()
        self.cut_marks = (
            self.by_word and kinds == ["Split", "ByteLevel"] and not spec["pre_tokenizer"]["pretokenizers"][1].get("add_prefix_space")
            and bool(suffix) and all(x in vocab and x + suffix in vocab for x in letters.values())
        )
        if self.cut_marks:
            self.as_letters = {c: "".join(letters[b] for b in chr(c).encode()) for c in range(0x180)}
            # The model alone, on pre-tokens with the space's letter between them; each ends with the only id that has the suffix.
            self.model = Tokenizer(self.tokenizer.model)
            self.model.pre_tokenizer = pre_tokenizers.Split(letters[32], "removed")
            self.last = np.zeros(self.size, bool)
            self.last[[i for token, i in vocab.items() if token.endswith(suffix)]] = True
        self.words, self.older_words = {}, {}
        self.cores, self.older_cores = {}, {}

    def _library(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, dtype=self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _new_pieces(self, pieces: list[bytes]) -> list[bytes]:
        """Ids of pre-tokens in lower case."""
        joined = b" ".join(pieces).decode().translate(self.as_letters)
        ids = np.array(self.model.encode_batch_fast([joined], add_special_tokens=False)[0].ids, self.dtype)
        cuts = ((np.flatnonzero(self.last[ids]) + 1) * self.dtype.itemsize).tolist()
        raw = ids.tobytes()
        return [raw[lo:hi] for lo, hi in zip([0, *cuts], cuts)]

    def _ids_of_pieces(self, pieces: pa.Array) -> list[bytes]:
        if len(self.cores) + len(pieces) > self.CORES:
            self.older_cores, self.cores = self.cores, {}
        memo, older = self.cores, self.older_cores
        asked = _bytes_of(pieces).tolist()
        found = list(map(memo.get, asked))
        missed = [i for i, ids in enumerate(found) if ids is None]
        new = []
        for i in missed:
            ids = found[i] = older.get(asked[i]) if asked[i] else b""  # words without closing marks
            if ids is None:
                new.append(i)
        if new:
            for i, ids in zip(new, self._new_pieces([asked[i] for i in new])):
                found[i] = ids
        memo.update((asked[i], found[i]) for i in missed)
        return found

    def _ids_by_library(self, words: pa.Array) -> list[bytes]:
        if len(self.words) + len(words) > self.WORDS:
            self.older_words, self.words = self.words, {}
        asked = _bytes_of(words).tolist()
        found = {w: self.words.get(w, self.older_words.get(w)) for w in asked}
        found[b""] = b""  # before the first word or after the last
        new = [w for w, ids in found.items() if ids is None]
        if new:
            found.update(zip(new, self._library([w.decode("utf-8", "replace") for w in new])))
        self.words.update(found)
        return [found[w] for w in asked]

    def _ids_of_words(self, words: pa.Array) -> pa.Array:
        """Ids of each of some distinct words."""
        if not self.cut_marks:
            return pa.array(self._ids_by_library(words), pa.binary())
        parts = pc.extract_regex(words, _PLAIN)  # null where a word has other letters
        plain = parts.is_valid()
        core, marks = (x.dictionary_encode() for x in parts.filter(plain).flatten())
        core = pc.utf8_lower(core.dictionary).take(core.indices).dictionary_encode()
        ids = [pa.array(self._ids_of_pieces(x.dictionary), pa.binary()).take(x.indices) for x in (core, marks)]
        both = pa.concat_arrays([pc.binary_join_element_wise(*ids, b""), pa.array(self._ids_by_library(words.filter(pc.invert(plain))), pa.binary())])
        # Plain words come first there, the others after them.
        plain = plain.to_numpy(zero_copy_only=False)
        place = np.where(plain, np.cumsum(plain) - 1, plain.sum() + np.cumsum(~plain) - 1)
        return both.take(pa.array(place))

    def _encode_slice(self, texts: pa.Array, end: bytes) -> pa.Array:
        if not self.by_word:
            return pa.array([ids + end for ids in self._library(texts.fill_null("").to_pylist())], pa.binary())
        split = pc.ascii_split_whitespace(texts.fill_null(""))
        bounds = split.offsets.to_numpy().astype(np.int64)
        words = split.flatten().dictionary_encode()
        ids = pa.concat_arrays([self._ids_of_words(words.dictionary), pa.array([end], pa.binary())])
        every = ids.take(pa.array(np.insert(words.indices.to_numpy(), bounds[1:], len(ids) - 1)))
        # The ids of all words lie in a row; those of a text begin where its first word does.
        starts = np.frombuffer(every.buffers()[1], np.int32)[bounds + np.arange(len(bounds))]
        return pa.Array.from_buffers(pa.binary(), len(texts), [None, pa.py_buffer(starts), every.buffers()[2]])

    def encode_all(self, texts: pa.Array, end: bytes = b"") -> Iterator[tuple[int, pa.Array]]:
        """Ids of whole texts as little-endian integers of type `dtype`, each with `end` after them; null gives only that.

        Comes in slices, with the place of each slice's first text.
        """
        texts = texts.cast(pa.string())
        ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy().astype(np.int64))
        lo = done = 0
        while lo < len(texts):
            hi = max(lo + 1, int(np.searchsorted(ends, done + self.SLICE, side="right")))
            yield lo, self._encode_slice(texts.slice(lo, hi - lo), end)
            lo, done = hi, int(ends[hi - 1])

    def encode(self, text: str | None) -> bytes:
        """Ids of one text."""
        return b"".join(ids[0].as_py() for _, ids in self.encode_all(pa.array([text], pa.string())))
