"""Token ids of whole texts, each distinct piece of text encoded once per worker.

Texts are cut where the tokenizer's own pre-tokenizer cuts in any context: before a single space or
line feed between two visible characters, and between an ASCII letter and ASCII punctuation. The
pieces of many texts are made distinct first, so that the tokenizer sees each piece once.
"""

from __future__ import annotations

import json
import re
import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from harvest.llm.common import byte_set, strings, text_bytes

CACHED_PIECES = 250_000     # pieces a worker remembers, about 50 MB

_VISIBLE = byte_set(bytes(range(33, 127)))
_ASCII = byte_set(bytes(range(128)))
_LETTER = byte_set(b"abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ")
_PUNCT = _VISIBLE & ~_LETTER & ~byte_set(b"0123456789")
_BLANK = byte_set(b" \n")
_EXOTIC = r"[\x{85}\x{a0}\x{1680}\x{180e}\x{2000}-\x{200f}\x{2028}\x{2029}\x{202f}\x{205f}\x{2060}\x{3000}\x{feff}]"
_LATIN_WORD = re.compile(" ?[A-Za-zÀ-ÖØ-öø-ÿ]+")

# fixed values of the public word-level pre-tokenizer pattern
_WORD_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


def _byte_letters() -> list[str]:
    """The printable character that byte-level tokenizers show for each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class Encoder:
    """Ids of texts by the tokenizer file at ``path``, without special tokens added."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t["content"] for t in spec.get("added_tokens", [])]
        before, normal = spec.get("pre_tokenizer") or {}, spec.get("normalizer") or {}
        kinds = [n["type"] for n in normal.get("normalizers", [])]
        split = (before.get("pretokenizers") or [{}])[0]
        plain = before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not normal
        words = (split.get("pattern") == {"Regex": _WORD_PATTERN} and split.get("behavior") == "Removed"
                 and kinds == ["NFC", "Replace", "Lowercase"])
        self.lower, self.cuts = words, plain or words       # other tokenizers: whole texts
        self.known: dict[str, bytes] = {}
        self.letters = str.maketrans(dict(enumerate(_byte_letters())))

    def _one_word(self, piece: str) -> bytes:
        """Ids of a piece that is one word of Latin-1 letters, by the model alone."""
        shown = (piece.lstrip().lower() if self.lower else piece).encode().decode("latin-1").translate(self.letters)
        return np.array([t.id for t in self.tokenizer.model.tokenize(shown)], np.uint32).tobytes()

    def _pieces(self, pieces: list[str]) -> list[bytes]:
        out = [self.known.get(p) for p in pieces]
        rest = [i for i, ids in enumerate(out) if ids is None]
        other = []
        for i in rest:
            if _LATIN_WORD.fullmatch(pieces[i]):
                out[i] = self._one_word(pieces[i])
            else:
                other.append(i)
        for i, e in zip(other, self.tokenizer.encode_batch_fast([pieces[i] for i in other], add_special_tokens=False)):
            out[i] = np.array(e.ids, np.uint32).tobytes()
        for i in rest[:max(0, CACHED_PIECES - len(self.known))]:
            if len(pieces[i]) < 64:
                self.known[pieces[i]] = out[i]
        return out

    def _cut(self, data: np.ndarray, offsets: np.ndarray, strict: bool) -> np.ndarray:
        cut = np.zeros(len(data) + 1, bool)
        if self.cuts and len(data) > 2:
            seen = _VISIBLE if strict else _VISIBLE | ~_ASCII
            kind = seen[data]
            cut[1:-2] |= _BLANK[data[1:-1]] & kind[:-2] & kind[2:]
            cut[1:-1] |= _LETTER[data[:-1]] & _PUNCT[data[1:]]
        cut[offsets] = True
        return np.flatnonzero(cut)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's begin (one more entry: the end). Null: empty."""
        texts = pc.fill_null(texts, "")
        own = np.zeros(len(texts), bool)                    # texts that spell a special token go whole
        for token in self.special:
            own |= pc.match_substring(texts, token).to_numpy(zero_copy_only=False)
        whole = {}
        if own.any():
            at = np.flatnonzero(own)
            found = self.tokenizer.encode_batch_fast(texts.take(pa.array(at)).to_pylist(), add_special_tokens=False)
            whole = {int(i): np.array(e.ids, np.uint32) for i, e in zip(at, found)}
            texts = pc.if_else(pa.array(own), "", texts)
        strict = bool(pc.any(pc.match_substring_regex(texts, _EXOTIC)).as_py())
        data, offsets = text_bytes(pc.ascii_lower(texts) if self.lower else texts)
        cuts = self._cut(data, offsets, strict)
        coded = strings(data, cuts).cast(pa.string()).dictionary_encode()
        parts = self._pieces(coded.dictionary.to_pylist())
        flat = np.frombuffer(b"".join(parts), np.uint32)
        lengths = np.fromiter((len(p) // 4 for p in parts), np.int64, len(parts))
        begins = np.cumsum(lengths) - lengths
        which = coded.indices.to_numpy()
        n = lengths[which]
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(ends) else 0
        ids = flat[np.repeat(begins[which] - (ends - n), n) + np.arange(total)] if total else np.zeros(0, np.uint32)
        starts = np.concatenate([[0], ends])[np.searchsorted(cuts, offsets)]
        if whole:
            rows = [whole.get(i, ids[starts[i]:starts[i + 1]]) for i in range(len(texts))]
            ids, starts = np.concatenate(rows), np.concatenate([[0], np.cumsum([len(r) for r in rows])])
        return ids, starts


def encoder(path: str) -> Encoder:
    """This worker's encoder for the tokenizer at ``path``; it keeps its known pieces between tasks.

    Code travels to the workers by value, so what is to outlive a task is kept with the library.
    """
    import tokenizers

    kept = vars(tokenizers).setdefault("_encoders_of_this_worker", {})
    if path not in kept:
        kept[path] = Encoder(path)
    return kept[path]


def with_end(ids: np.ndarray, starts: np.ndarray, end: int) -> tuple[np.ndarray, np.ndarray]:
    """The ids with ``end`` after each text's, and their new starts."""
    n = len(starts) - 1
    out = np.empty(len(ids) + n, np.uint32)
    ends = starts[1:] + np.arange(n)
    own = np.ones(len(out), bool)
    own[ends] = False
    out[ends], out[own] = end, ids
    return out, np.concatenate([[0], ends + 1])


def crc32(ids: np.ndarray) -> int:
    """Unsigned crc32 of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(np.ascontiguousarray(ids, "<u4"))
