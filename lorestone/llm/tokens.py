"""Token ids of whole texts, by public tokenizers whose files stay where they are."""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex

from .common import SPACE, buffers, chunks

#: Where text ends and white space begins, no match of the pre-tokenizer goes on, so the pieces of a text can be encoded
#: apart, and each distinct piece once. Most texts can be cut at single blanks; in others, white space meets a blank.
_PIECE = re.compile(r"\s*\S+|\s+")
#: White space beyond ASCII, as UTF-8.
_WIDE_SPACE = np.array([int.from_bytes(chr(c).encode()) for c in (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)], np.uint32)
#: White space to Python, but not to the tokenizers; rare enough to encode such texts whole.
_UNSURE = re.compile("[\x00\x1c-\x1f]")
#: Pieces remembered by each Python worker, as Arrow arrays: about 25 MB.
REMEMBER = 600_000
#: Bytes of text whose distinct pieces are looked up at once.
SLICE = 6 << 20
#: What the files' pre-tokenizers cut pieces of Latin-1 letters, marks and digits into, by whether white space is dropped.
#: Other scripts are cut by the pre-tokenizers themselves.
_CUT = {
    False: regex.compile(r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"),
    True: regex.compile(r"'(?:[sdmt]|ll|ve|re)|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+"),
}


def _byte_characters() -> dict[int, str]:
    """The printable character that stands for each byte in the vocabularies: itself, or the next from U+0100 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


_CHARACTER = _byte_characters()


def public_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids of texts as packed little-endian integers of two bytes (four for vocabularies beyond 65,536).

    Each distinct piece of a text is encoded once and remembered. New pieces are encoded together, as one long text; the
    lengths of the tokens' strings, a character for each byte, tell where each piece's ids end. Known pieces and their
    ids are Arrow arrays, so that only new pieces become Python strings."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        vocabulary = self.tokenizer.get_vocab()
        self.dtype = id_dtype(path)
        self.width = self.dtype.itemsize
        self.lengths = np.zeros(max(vocabulary.values()) + 1, np.int64)
        for token, i in vocabulary.items():
            self.lengths[i] = len(token.removesuffix("</w>"))
        #: White space is dropped: words are encoded without it.
        self.drops_space = self._ids("a \n\t a").tolist() == self._ids("a a").tolist() == self._ids("a").tolist() * 2
        self.merges = self._merges(path)
        self.known = pa.array([""], pa.large_string())
        self.ids = pa.array([b""], pa.large_binary())

    @staticmethod
    def _merges(path: str):
        """The file's merges alone, for words that are cut and spelled in byte characters already: without the alignment
        of characters that the whole tokenizer keeps, which nothing here reads. None for other kinds of model."""
        from tokenizers import Tokenizer, models, pre_tokenizers

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        if model.get("type") != "BPE":
            return None
        options = {k: v for k, v in model.items() if k not in ("type", "vocab", "merges") and v is not None}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        out = Tokenizer(models.BPE(vocab=model["vocab"], merges=pairs, cache_capacity=0, **options))
        out.pre_tokenizer = pre_tokenizers.Split(" ", "removed")
        return out

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)

    def _spelled(self, text: str) -> np.ndarray:
        """Ids of Latin-1 text. It holds no \\0, which stands between what is cut meanwhile."""
        cut = _CUT[self.drops_space].findall(text.lower() if self.drops_space else text)
        spelled = "\0".join(cut).encode().decode("latin-1").translate(_CHARACTER).replace(_CHARACTER[0], " ")
        return np.array(self.merges.encode_batch_fast([spelled], add_special_tokens=False)[0].ids, self.dtype)

    def _encode_new(self, words: pa.Array, latin: bool) -> list[tuple[np.ndarray, np.ndarray]]:
        """(ids, where each word's end) of words that follow a blank, without it; in runs that are encoded together."""
        text = " " + pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), pa.scalar(" ", pa.large_string()))[0].as_py()
        if latin:
            ids = self._spelled(text)
        else:
            ids = self._ids(text)
            if self.drops_space:
                text = unicodedata.normalize("NFC", text).lower()
        ends = np.cumsum(self.lengths[ids])
        blanks = np.flatnonzero(np.frombuffer(raw := text.encode(), np.uint8) == 32)
        want = np.append(blanks[1:], len(raw)) - self.drops_space * np.arange(1, len(blanks) + 1)
        at = np.searchsorted(ends, want, "right")
        if len(ends) and len(want) == len(words) and np.array_equal(ends[at - 1], want) and want[-1] == ends[-1]:
            return [(ids, at)]
        if len(words) == 1:
            ids = self._ids(text)
            return [(ids, np.array([len(ids)]))]
        half = len(words) // 2
        return self._encode_new(words[:half], latin) + self._encode_new(words[half:], latin)

    def _learn(self, pieces: pa.Array) -> np.ndarray:
        """Append new pieces and their ids; where each is then. A piece after \\0 starts its text or holds its own white
        space; it is encoded as it is. Latin-1 is what has no byte above that of U+00FF."""
        data, at = buffers(pieces)
        high, some = np.zeros(len(pieces), np.uint8), np.flatnonzero(np.diff(at))
        high[some] = np.maximum.reduceat(data[at[0] : at[-1]], at[some] - at[0])
        own = np.zeros(len(pieces), bool)
        own[some] = data[at[some]] == 0
        latin = ~own & (high <= 0xC3) if self.merges else np.zeros(len(pieces), bool)
        order, parts = [], []
        for group in (latin, ~latin & ~own, own):
            which = np.flatnonzero(group)
            order.append(which)
            for i in range(0, len(which), 2000):
                words = pieces.take(pa.array(which[i : i + 2000]))
                if group is own:
                    found = self.tokenizer.encode_batch_fast([p[1:] for p in words.to_pylist()], add_special_tokens=False)
                    ids = [np.array(x.ids, self.dtype) for x in found]
                    parts.append((np.concatenate(ids), np.cumsum([len(x) for x in ids])))
                else:
                    parts += self._encode_new(words, group is latin)
        order = np.concatenate(order)
        before = np.cumsum([0, *(len(ids) for ids, _ in parts)])
        ends = np.concatenate([[0], *(at + n for (_, at), n in zip(parts, before))]).astype(np.int64) * self.width
        raw = pa.py_buffer(np.concatenate([ids for ids, _ in parts]).tobytes())
        ids = pa.Array.from_buffers(pa.large_binary(), len(order), [None, pa.py_buffer(ends), raw])
        place = np.empty(len(order), np.int64)
        place[order] = len(self.known) + np.arange(len(order))
        self.known, self.ids = pa.concat_arrays([self.known, pieces.take(pa.array(order))]), pa.concat_arrays([self.ids, ids])
        return place

    def _places(self, pieces: pa.Array) -> np.ndarray:
        """Where each of these distinct pieces is among the known ones, which they join."""
        at = pc.index_in(pieces, value_set=self.known)
        if not at.null_count:
            return at.to_numpy()
        missing = at.is_null().to_numpy(zero_copy_only=False)
        out = at.fill_null(0).to_numpy().astype(np.int64)
        if len(self.known) + at.null_count > REMEMBER:
            # What this slice holds too stays known, and so the frequent pieces; the empty one stays first.
            kept, again = np.unique(np.append(out[~missing], 0), return_inverse=True)
            self.known, self.ids = self.known.take(pa.array(kept)), self.ids.take(pa.array(kept))
            out[~missing] = again[:-1]
        out[missing] = self._learn(pieces.filter(pa.array(missing)))
        return out

    def _joined(self, pieces: pa.ListArray) -> pa.LargeBinaryArray:
        """For each list of pieces their ids, end to end: distinct pieces are looked up, then copied to their places."""
        coded = pieces.values.dictionary_encode()
        places = self._places(coded.dictionary)[coded.indices.to_numpy()]
        flat = self.ids.take(pa.array(places))
        _, ends, raw = flat.buffers()
        ends = np.frombuffer(ends, np.int64)[np.asarray(pieces.offsets)] if len(flat) else np.zeros(len(pieces) + 1, np.int64)
        return pa.Array.from_buffers(pa.large_binary(), len(pieces), [None, pa.py_buffer(ends), raw or pa.py_buffer(b"")])

    def _odd(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Which texts can't be cut at single blanks (or, for tokenizers that drop it, at white space)."""
        seg, at = data[at[0] : at[-1]], at - at[0]
        odd = np.zeros(len(at) - 1, bool)
        places = [np.flatnonzero((seg == 0) | ((seg >= 0x1C) & (seg <= 0x1F)))]
        if not self.drops_space:
            some = at[:-1] < at[1:]
            odd[some] = (seg[at[:-1][some]] == 32) | (seg[at[1:][some] - 1] == 32)
            blank = np.flatnonzero(seg == 32)
            blank = blank[blank > 0]
            places.append(blank[SPACE[seg[blank - 1]]])
            wide = blank[seg[blank - 1] >= 0x80]
            code = sum(seg[np.maximum(wide - k, 0)].astype(np.uint32) << np.uint32(8 * (k - 1)) for k in (1, 2, 3))
            places.append(wide[np.isin(code, _WIDE_SPACE) | np.isin(code & np.uint32(0xFFFF), _WIDE_SPACE)])
        for where in places:
            odd[np.searchsorted(at, where, "right") - 1] = True
        return odd

    def encode_column(self, texts: pa.Array) -> pa.LargeBinaryArray:
        """The ids of each text, null being empty."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if not len(texts):
            return pa.array([], pa.large_binary())
        odd = self._odd(*buffers(texts))
        plain = texts.filter(pa.array(~odd)) if odd.any() else texts
        if self.drops_space:
            parts = [self._joined(pc.utf8_split_whitespace(plain))]
        else:
            nothing = pa.scalar("", pa.large_string())
            parts = [self._joined(pc.split_pattern(pc.binary_join_element_wise(pa.scalar("\0", pa.large_string()), plain, nothing), pattern=" "))]
        if not odd.any():
            return parts[0]
        own = [["\0" + t] if _UNSURE.search(t) else ["\0" + p for p in _PIECE.findall(t)] for t in texts.filter(pa.array(odd)).to_pylist()]
        parts.append(self._joined(pa.array(own, pa.list_(pa.large_string()))))
        place = np.empty(len(odd), np.int64)
        place[~odd], place[odd] = np.arange(len(odd) - odd.sum()), np.arange(len(odd) - odd.sum(), len(odd))
        return pa.concat_arrays(parts).take(pa.array(place))

    def encode(self, texts: list[str | None]) -> list[bytes]:
        return self.encode_column(pa.array(texts, pa.large_string())).to_pylist()


@lru_cache(maxsize=4)
def id_dtype(path: str) -> np.dtype:
    """The dtype of an encoder's ids, told from its file alone."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    vocabulary, added = data["model"]["vocab"], [x["id"] for x in data.get("added_tokens") or ()]
    last = max(vocabulary.values()) if isinstance(vocabulary, dict) else len(vocabulary) - 1
    return np.dtype("<u2" if max([last, *added]) < 1 << 16 else "<u4")


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One for each worker process and file."""
    return Encoder(path)


def encoded(texts: pa.Array, from_text: Encoder, most: int = SLICE):
    """(from, to, ids of these texts) for slices of about `most` bytes."""
    for a, b in chunks(buffers(texts)[1], most):
        yield a, b, from_text.encode_column(texts.slice(a, b - a))
