"""BPE encoding by per-prefix dynamic programming, and decoding.

The only token that can end the encoding of a prefix is found for every prefix of a word, left to right: an
automaton reports all tokens that end at a place, and of these the one counts that begins the word or whose pair
with the last token of the shorter prefix is itself a valid encoding. Back-pointers then give the ids. The work is
linear in the word times the tokens that end at a place, however long the word is.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
import string
import sys
import unicodedata
from array import array
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from hearken.llm.common import small_batches, text_of

_END = 0x1000  # added to the code point of a word's last symbol: it carries the end-of-word mark
_SPACE = regex.compile(r"[\t-\r \x85   -     　]+")
#: Letters and digits of a newer Unicode than the tokenizer's; to it they are other characters.
_NEW = "558 58b-58c 88f c5c cdc 208f 209d-209f a7ce-a7cf a7d2 a7d4 a7dd a7e2 a7f1 ab6c-ab6d 107bb-107bf 10940-10959 10ec5-10ec7 10ed9-10eee 11b0a 11db0-11ddb 11de0-11de9 11df1 1246f 12475-1247f 12550-12686 16ea0-16eb8 16ebb-16ed3 16ff2-16ff6 187f8-187ff 18cd6-18cda 18d09-18d20 18d80-18df2 18e00-19191 191a0-191d2 1b123-1b128 1b168 1d6a6 1df1f-1df24 1df2b-1df81 1df90-1df96 1dfcd-1dfff 1e6c0-1e6de 1e6e0-1e6e2 1e6e4-1e6e5 1e6e7-1e6ed 1e6f0-1e6f4 1e6fe-1e6ff 2b73a-2b73f 2b81e 2cea2-2cead 323b0-33479 3d000-3fc3f"
_NEW_SET = "[" + "".join("-".join(f"\\U{int(x, 16):08x}" for x in r.split("-")) for r in _NEW.split()) + "]"
_PIECE = regex.compile(r"(?V1)'s|'t|'re|'ve|'m|'ll|'d|[\p{L}--{_NEW_SET}]+|[\p{N}--{_NEW_SET}]|[[^\s\p{L}\p{N}]||{_NEW_SET}]+".replace("{_NEW_SET}", _NEW_SET))
_ODD = re.compile(r"[\x1c-\x1f]")  # str.split() takes these for white space, the tokenizer doesn't
#: Lower-casing is by character (a sigma that ends a word is no exception) and knows newer letters than Python does.
_LOWER = {ord("Σ"): "σ", 0x1C89: 0x1C8A, 0xA7CB: 0x264, 0xA7CC: 0xA7CD, 0xA7CE: 0xA7CF, 0xA7D2: 0xA7D3, 0xA7D4: 0xA7D5, 0xA7DA: 0xA7DB, 0xA7DC: 0x19B}
_LOWER |= {c: c + 0x20 for c in range(0x10D50, 0x10D66)} | {c: c + 0x1B for c in range(0x16EA0, 0x16EB9)}
_RARE = [*map(chr, _LOWER)]


def _byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


def _packed(ids: list[int]) -> bytes:
    a = array("I", ids)
    if sys.byteorder == "big":
        a.byteswap()
    return a.tobytes()


class _Words(dict):
    """ids of words as bytes, in two generations of `limit` words each: when one is full the older goes, but words
    met again move to the newer. So memory is bounded, and only speed depends on it."""

    def __init__(self, make, limit: int):
        self.make, self.limit, self.older = make, limit, {}

    def __missing__(self, word: str) -> bytes:
        ids = self.older.get(word)
        if ids is None:
            ids = self.make(word)
        if len(word) <= 48:
            if len(self) >= self.limit:
                self.older = dict(self)
                self.clear()
            self[word] = ids
        return ids


class WordBpe:
    """Encoder and decoder of a word-level BPE file: NFC, lower case, white space dropped, marks at word ends.

    encode() gives the ids as little-endian unsigned 32-bit integers; special strings inside a text become their
    special ids. An empty text has no ids.
    """

    def __init__(self, path: str, cached_words: int = 400_000):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_at = regex.compile("|".join(sorted(map(regex.escape, self.special), key=len, reverse=True))) if self.special else None
        self.tokens: list[str] = [""] * (1 + max([*vocab.values(), *self.special.values()]))
        for s, i in [*vocab.items(), *self.special.items()]:
            self.tokens[i] = s
        self.symbols = "".join(_byte_symbols())
        self._prepare(path, model)
        self.cache = _Words(self._word, cached_words)

    def _prepare(self, path: str, model: dict) -> None:
        """What _piece() needs."""
        vocab: dict[str, int] = model["vocab"]
        end = model["end_of_word_suffix"]
        coded = lambda s: s[: -len(end) - 1] + chr(ord(s[-len(end) - 1]) + _END) if s.endswith(end) and len(s) > len(end) else s
        self.before = [0] * len(self.tokens)  # by which a token's length takes one back
        self.automaton = ahocorasick.Automaton()
        for s, i in vocab.items():
            self.before[i] = len(c := coded(s))
            self.automaton.add_word(c, i)
        self.automaton.make_automaton()
        # A token's rank is the place of the merge that makes it; ids of symbols rank below all merges.
        self.rank, self.parts, self.pairs = [-1] * len(self.tokens), [None] * len(self.tokens), {}
        for n, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            i = vocab[(left[: -len(end)] if left.endswith(end) else left) + right]
            a, b = vocab[left], vocab[right]
            self.rank[i], self.parts[i], self.pairs[a, b] = n, (a, b), (n, i)
        self.fits: list[dict[int, bool]] = [{} for _ in self.tokens]  # by the first token, whether the second may follow
        self.known = 0

    def _compatible(self, a: int, b: int) -> bool:
        """Whether [a, b] is what encoding their joined text gives: undoing merges, newest first, no pair across
        the border may have been merged before the ones undone so far."""
        parts, rank, pairs = self.parts, self.rank, self.pairs
        limit = 1 << 30  # merges of this rank or later can't have come before those undone
        from_left = False
        while True:
            made = pairs.get((a, b))
            if made and (made[0] < limit or (made[0] == limit and not from_left)):
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, from_left = ra, True
                a = parts[a][1]
            else:
                limit, from_left = rb, False
                b = parts[b][0]

    def _symbols(self, piece: str) -> str:
        return codecs.charmap_decode(piece.encode("utf-8"), "strict", self.symbols)[0]

    def _piece(self, piece: str) -> list[int]:
        s = self._symbols(piece)
        last, before, fits, done = [], self.before, self.fits, -1
        for place, t in self.automaton.iter(s[:-1] + chr(ord(s[-1]) + _END)):
            if place == done:
                continue
            if (b := place - before[t]) >= 0:
                row = fits[last[b]]
                ok = row.get(t)
                if ok is None:
                    ok = row[t] = self._compatible(last[b], t)
                    self.known += 1
                if not ok:
                    continue
            last.append(t)
            done = place
        if self.known > 500_000:
            self.known, self.fits = 0, [{} for _ in self.tokens]
        ids, e = [], done
        while e >= 0:
            ids.append(t := last[e])
            e -= before[t]
        ids.reverse()
        return ids

    def _word(self, word: str) -> bytes:
        core = word.rstrip(string.punctuation)  # letters and what follows them are one piece each
        if core.isalpha() and (core.isascii() or max(core) < "\u0558"):
            return _packed(self._piece(word)) if len(core) == len(word) else self.cache[core] + self.cache[word[len(core) :]]
        pieces = _PIECE.findall(word)
        if len(pieces) == 1:
            return _packed(self._piece(word))
        return b"".join(map(self.cache.__getitem__, pieces))

    def words(self, text: str) -> list[str]:
        """The normalized words of a text without special strings."""
        text = unicodedata.normalize("NFC", text)
        if not text.isascii() and any(map(text.__contains__, _RARE)):
            text = text.translate(_LOWER)
        text = text.lower()
        return text.split() if not _ODD.search(text) else [w for w in _SPACE.split(text) if w]

    def _plain(self, text: str) -> bytes:
        return b"".join(map(self.cache.__getitem__, self.words(text)))

    def encode(self, text: str) -> bytes:
        if self.special_at is None or not self.special_at.search(text):
            return self._plain(text)
        out, at = [], 0
        for m in self.special_at.finditer(text):
            out += [self._plain(text[at : m.start()]), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, self._plain(text[at:])])

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


class LibraryBpe(WordBpe):
    """WordBpe that leaves the merges inside a piece to the tokenizers library: the same ids, in some 60 % of the time for a new piece."""

    def _prepare(self, path: str, model: dict) -> None:
        self.model = Tokenizer.from_file(path).model

    def _piece(self, piece: str) -> list[int]:
        return [t.id for t in self.model.tokenize(self._symbols(piece))]


_loaded: dict[tuple[type[WordBpe], str], WordBpe] = {}


def word_bpe(path: str, kind: type[WordBpe] = WordBpe) -> WordBpe:
    """The encoder of a file; a Python worker keeps it, and its words, from task to task."""
    if (kind, path) not in _loaded:
        _loaded[kind, path] = kind(path)
    return _loaded[kind, path]


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_tokens, ids (binary) and decoded.

    A null or empty text has no ids and decodes to ""; null ids and repeated rows are kept as they are; other
    columns are ignored. There is no shuffle: every text is encoded where it is read.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for batch in batches:
            ids = [bpe.encode(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(i) // 4 for i in ids], pa.int64()), pa.array(ids, pa.binary()), pa.array([bpe.decode(i) for i in ids], pa.string())], [id_col, "n_tokens", "ids", "decoded"])

    return docs.select(id_col, text_of(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids binary, decoded string")


def encode_digests(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: as encode_documents, but ids and texts stay in the worker."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = word_bpe(path), hashlib.sha256
        for batch in batches:
            n, a, b = [], [], []
            for t in batch.column(1).to_pylist():
                ids = bpe.encode(t)
                n.append(len(ids) // 4)
                a.append(sha(ids).hexdigest())
                b.append(sha(bpe.decode(ids).encode("utf-8")).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a, pa.string()), pa.array(b, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", text_of().alias("t")).mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")
