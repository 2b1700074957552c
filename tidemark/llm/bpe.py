"""Byte-level BPE encoding and decoding in batched numpy merge rounds."""

from __future__ import annotations

import functools
import heapq
import json
import re
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .batches import map_texts
from .words import WordMemory

_NEVER = np.iinfo(np.int64).max
#: Words of more bytes merge through a heap, as rounds over one word need not be few.
LONG_WORD = 512
#: Bytes of words merged in one flat array.
FLAT_BYTES = 1 << 20

# White space of the pattern, as characters and as its non-ASCII or rare forms in UTF-8.
_WS = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_RARE_WS = re.compile(rb"[\x0b\x0c]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80")
# Fixed value: the public pattern of byte-level BPE, its white space spelled out.
PATTERN = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{_WS}\p{{L}}\p{{N}}]+|[{_WS}]+(?![^{_WS}])|[{_WS}]+"
# Words with the white space before them: the pattern never looks beyond one.
_WORDS = re.compile(rb"[ \n\t\r]*[^ \n\t\r]+|[ \n\t\r]+")
_ANY_WORDS = re.compile(f"[{_WS}]*[^{_WS}]+|[{_WS}]+")


def byte_characters() -> dict[str, int]:
    """The characters that stand for bytes in the vocabulary file: printable ones for themselves, others from U+0100 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class BytePairs:
    """Vocabulary and merges of a byte-level BPE file, as arrays."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        kind = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or kind["type"] != "ByteLevel" or kind["add_prefix_space"] or not kind["use_regex"]:
            raise ValueError(f"not a plain byte-level BPE file: {path}")
        vocab = spec["model"]["vocab"]
        of = byte_characters()
        self.size = max(vocab.values()) + 1
        self.first = np.zeros(256, dtype=np.int64)
        for c, b in of.items():
            self.first[b] = vocab[c]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] * self.size + vocab[b] for a, b in pairs], dtype=np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.ranks = keys[order], order.astype(np.int64)
        self.merged = np.array([vocab[a + b] for a, b in pairs], dtype=np.int64)
        self.special = {t["content"].encode(): t["id"] for t in spec["added_tokens"]}
        if any(t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] for t in spec["added_tokens"]):
            raise ValueError(f"added tokens with options: {path}")
        known = {i: bytes(of[c] for c in s) for s, i in vocab.items()} | {i: s for s, i in self.special.items()}
        self.table = [known.get(i, b"") for i in range(max(known) + 1)]
        self.pieces = regex.compile(PATTERN).findall
        self.split_special = re.compile(b"(" + b"|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + b")") if self.special else None
        self.words = WordMemory(lambda w: self.encode_words([w])[0])
        self.parts = WordMemory(lambda p: self.merge_all([p])[0], 150_000)

    def rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Ranks of pairs, _NEVER for those that no merge joins, by binary search over the sorted pair keys."""
        if not len(self.keys):
            return np.full(len(left), _NEVER)
        key = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], _NEVER)

    def ranks_in(self, flat: np.ndarray, owner: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Ranks of the pairs that begin at the places ``at``, _NEVER at the end of a piece."""
        found = np.full(len(at), _NEVER)
        inner = np.flatnonzero(owner[np.minimum(at + 1, len(flat) - 1)] == owner[at]) if len(flat) else at
        inner = inner[at[inner] + 1 < len(flat)]
        found[inner] = self.rank(flat[at[inner]], flat[at[inner] + 1])
        return found

    def merge(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of each piece: rounds over one flat array of the symbols of all pieces. In each round every piece joins all places of its lowest-ranked pair, from the left; pieces without a pair leave the array."""
        flat = self.first[np.frombuffer(b"".join(pieces), dtype=np.uint8)]
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        owner = np.repeat(np.arange(len(pieces)), sizes)
        rank = self.ranks_in(flat, owner, np.arange(len(flat)))
        left_owner, left_ids = [], []
        while len(flat):
            starts = np.flatnonzero(np.concatenate(([True], owner[1:] != owner[:-1])))
            lowest = np.repeat(np.minimum.reduceat(rank, starts), np.diff(np.append(starts, len(flat))))
            going = lowest != _NEVER
            left_owner.append(owner[~going])
            left_ids.append(flat[~going])
            # of equal pairs that overlap, every second one
            at = np.flatnonzero(going & (rank == lowest))
            new_run = np.concatenate(([True], np.diff(at) > 1))[: len(at)]
            run_start = np.maximum.accumulate(np.where(new_run, np.arange(len(at)), 0)) if len(at) else at
            at = at[(np.arange(len(at)) - run_start) % 2 == 0]
            flat[at] = self.merged[rank[at]]
            going[at + 1] = False
            joined = np.cumsum(going)[at] - 1
            flat, owner, rank = flat[going], owner[going], rank[going]
            # only pairs beside a joined symbol are new
            near = np.concatenate((joined, joined[joined > 0] - 1))
            rank[near] = self.ranks_in(flat, owner, near)
        owners = np.concatenate(left_owner) if left_owner else np.zeros(0, dtype=np.int64)
        ids = np.concatenate(left_ids)[np.argsort(owners, kind="stable")] if left_ids else owners
        packed = ids.astype("<u4").tobytes()
        ends = (4 * np.cumsum(np.bincount(owners, minlength=len(pieces)))).tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def merge_long(self, piece: bytes) -> bytes:
        """Packed ids of one long piece: the lowest and leftmost pair first, from a heap over a linked list."""
        ids = self.first[np.frombuffer(piece, dtype=np.uint8)].tolist()
        n = len(ids)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        rank = self.rank(np.array(ids[:-1]), np.array(ids[1:]))
        heap = [(int(r), i, ids[i], ids[i + 1]) for i, r in enumerate(rank) if r != _NEVER]
        heapq.heapify(heap)

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n:
                r = int(self.rank(np.array([ids[i]]), np.array([ids[after[i]]]))[0])
                if r != _NEVER:
                    heapq.heappush(heap, (r, i, ids[i], ids[after[i]]))

        while heap:
            r, i, left, right = heapq.heappop(heap)
            j = after[i]
            if ids[i] != left or j >= n or ids[j] != right:
                continue
            ids[i], ids[j] = int(self.merged[r]), -1
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i])
            offer(i)
        return np.array([x for x in ids if x >= 0], dtype="<u4").tobytes()

    def cut(self, word: bytes) -> list[bytes]:
        """The pattern's pieces of a word with the white space before it."""
        text = word.decode("utf-8", "replace")
        core = text[1:] if text[:1] == " " else text
        if core.isalpha():
            return [word]
        if core[-1:] in ",.!?;:" and core[:-1].isalpha():
            return [word[:-1], word[-1:]]
        return [p.encode() for p in self.pieces(text)]

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """Packed ids of pieces: short ones in flat arrays of FLAT_BYTES, long ones each by itself."""
        ids: dict[int, bytes] = {}
        held, size = [], 0
        for k, p in enumerate(pieces):
            if len(p) > LONG_WORD:
                ids[k] = self.merge_long(p)
                continue
            held.append(k)
            size += len(p)
            if size >= FLAT_BYTES:
                ids.update(zip(held, self.merge([pieces[i] for i in held]), strict=True))
                held, size = [], 0
        ids.update(zip(held, self.merge([pieces[i] for i in held]), strict=True))
        return [ids[k] for k in range(len(pieces))]

    def encode_words(self, words: list[bytes]) -> list[bytes]:
        """Packed ids (unsigned 32 bits, little endian) of words that the pattern cuts on their own."""
        parts = [self.cut(w) for w in words]
        self.parts.learn({p for c in parts for p in c}, self.merge_all)
        get = self.parts.__getitem__
        done = [get(c[0]) if len(c) == 1 else b"".join(map(get, c)) for c in parts]
        self.parts.turn()
        return done

    def split(self, text: bytes) -> list[bytes]:
        if (b"\x0b" in text or b"\x0c" in text) if text.isascii() else _RARE_WS.search(text):
            return [w.encode() for w in _ANY_WORDS.findall(text.decode("utf-8", "replace"))]
        return _WORDS.findall(text)

    def encode_batch(self, texts: list[bytes]) -> list[bytes]:
        """Packed ids of whole texts. Strings of special tokens become those tokens, as in the library's default."""
        sections = []
        for text in texts:
            cut = self.split_special.split(text) if self.split_special and any(s in text for s in self.special) else [text]
            sections.append([self.special.get(s, None) if k % 2 else self.split(s) for k, s in enumerate(cut)])
        self.words.learn({w for t in sections for s in t if isinstance(s, list) for w in s}, self.encode_words)
        get = self.words.__getitem__
        done = [b"".join(b"".join(map(get, s)) if isinstance(s, list) else s.to_bytes(4, "little") for s in t) for t in sections]
        self.words.turn()
        return done

    def decode_batch(self, packed: list[bytes]) -> list[str]:
        """Texts of packed ids, special tokens included; unknown ids are left out and bad UTF-8 replaced."""
        get, out = self.table.__getitem__, []
        for x in packed:
            ids = np.frombuffer(x, dtype="<u4")
            if len(ids) and ids.max() >= len(self.table):
                ids = ids[ids < len(self.table)]
            out.append(b"".join(map(get, ids.tolist())).decode("utf-8", "replace"))
        return out


@functools.cache
def loaded(path: str) -> BytePairs:
    """One vocabulary for each worker, which keeps it and its memory of words over tasks."""
    return BytePairs(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", packed: bool = False) -> DataFrame:
    """``id_col`` and ``ids`` of every whole text by the byte-level BPE file at ``path``: an array of int or, if ``packed``, unsigned 32-bit little-endian integers in a binary.

    Null and empty texts have no ids. Executors read ``path``.
    """
    if packed:
        return map_texts(df, lambda: lambda texts: [loaded(path).encode_batch(texts)], [("ids", T.BinaryType(), pa.binary())], text_col, (id_col,))

    def kernel(texts: list[bytes]) -> list:
        return [[np.frombuffer(x, dtype="<u4").astype(np.int32) for x in loaded(path).encode_batch(texts)]]

    return map_texts(df, lambda: kernel, [("ids", T.ArrayType(T.IntegerType()), pa.list_(pa.int32()))], text_col, (id_col,))


def decode(df: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids", keep: tuple[str, ...] = ()) -> DataFrame:
    """``id_col``, the columns ``keep`` and the ``text`` of packed ids (see ``encode``); null ids give the empty text."""
    return map_texts(df, lambda: lambda ids: [loaded(path).decode_batch(ids)], [("text", T.StringType(), pa.string())], ids_col, (id_col, *keep))


def round_trip(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, the packed ``ids`` of every whole text and the ``decoded`` text of these ids, in one pass: what ``decode`` of ``encode`` gives."""

    def kernel(texts: list[bytes]) -> list:
        ids = loaded(path).encode_batch(texts)
        return [ids, loaded(path).decode_batch(ids)]

    return map_texts(df, lambda: kernel, [("ids", T.BinaryType(), pa.binary()), ("decoded", T.StringType(), pa.string())], text_col, (id_col,))
