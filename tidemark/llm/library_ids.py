"""Token ids by the tokenizers library, whose work on repeated words is remembered."""

from __future__ import annotations

import functools
import os
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import few_at_once, parts_of, quoted
from .bpe import byte_characters
from .words import WordMemory

#: Text bytes whose pieces are numbered at once; a longer text comes alone.
SLICE_BYTES = 4 << 20
#: Pieces, and strange words, remembered in one generation.
PIECES, WORDS = 100_000, 20_000
# Characters that lower and normalize in Arrow and Python as in the library; texts with any other, or with what may be a special token, are STRANGE.
_PLAIN = "!-~\xa1-\xac\xae-\u012f\u0131-\u0137\u0139-\u0148\u014a-\u017e\u0401\u0410-\u044f\u0451\u2010-\u2027\u20ac\u3001\u3002\u4e00-\u9fa5"
STRANGE = f"[^\\t-\\r {_PLAIN}]|<\\|"
# Of the public pattern of the word-end BPE all that isn't a run of letters, in Arrow's syntax.
_APART = r"'s|'t|'re|'ve|'m|'ll|'d|\pN|[^\s\pL\pN]+"


class LibraryIds:
    """Ids (at most 65,536 kinds) of whole texts by a tokenizer file that drops white space and never looks beyond it.

    Texts of plain characters are cut into pieces by the tokenizer's pattern, and each distinct piece of a slice is looked at once, for the BPE model if it isn't remembered. Of other texts each word goes to the whole tokenizer.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        if self.tokenizer.get_vocab_size() > 1 << 16:
            raise ValueError(f"over 65,536 ids: {path}")
        self.model = self.tokenizer.model
        self.spelled = str.maketrans({chr(b): c for c, b in byte_characters().items()})
        self.pieces = WordMemory(self.encode_piece, PIECES)
        self.words = WordMemory(self.encode_word, WORDS)

    def encode_piece(self, piece: bytes) -> bytes:
        spelled = piece.decode("latin-1").translate(self.spelled)
        return array("H", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def encode_word(self, word: bytes) -> bytes:
        return np.array(self.tokenizer.encode(word.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u2").tobytes()

    def encode_plain(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the number of ids before each text and in all."""
        words = pc.ascii_split_whitespace(pc.replace_substring_regex(pc.utf8_lower(texts), _APART, r" \0 "))
        numbered = words.flatten().dictionary_encode()
        distinct = numbered.dictionary.cast(pa.large_binary()).to_pylist()
        known = list(map(self.pieces.__getitem__, distinct))
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 2
        flat = np.frombuffer(b"".join(known), "<u2")
        of_piece = numbered.indices.to_numpy()
        n = sizes[of_piece]
        ends = np.append(0, np.cumsum(n))
        ids = flat[np.arange(ends[-1]) + np.repeat((np.cumsum(sizes) - sizes)[of_piece] - ends[:-1], n)]
        return ids, ends[words.offsets.to_numpy() - words.offsets[0].as_py()]

    def encode_slice(self, texts: pa.Array, end_id: int | None, kind: str) -> pa.Array:
        """Packed ids (numpy's ``kind``) of each text in UTF-8 (null: empty), with ``end_id`` appended if given."""
        texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
        strange = np.array([x is not False for x in pc.match_substring_regex(texts.view(pa.large_string()), STRANGE).to_pylist()], dtype=bool)
        ids, at = self.encode_plain(texts.filter(pa.array(~strange)).view(pa.large_string()))
        end = np.array([] if end_id is None else [end_id], dtype=kind).tobytes()
        packed = memoryview(ids.astype(kind).tobytes())
        size = np.dtype(kind).itemsize
        plain = (packed[size * i : size * j] for i, j in zip(at.tolist(), at[1:].tolist()))
        other = (np.frombuffer(b"".join(map(self.words.__getitem__, x.as_py().split())), "<u2").astype(kind).tobytes() for x in texts.filter(pa.array(strange)))
        return pa.array([b"".join((next(other if s else plain), end)) for s in strange.tolist()], pa.binary())


@functools.cache
def loaded(path: str) -> LibraryIds:
    return LibraryIds(path)


def encode(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end_id: int | None = None, bits: int = 16) -> DataFrame:
    """``id_col`` and ``ids`` (packed, unsigned ``bits`` of 16 or 32, little endian) of every whole text, with ``end_id`` appended if given.

    Null and empty texts have no ids but ``end_id``. Executors read ``path``.
    """
    kind = f"<u{bits // 8}"
    few_at_once(df.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts_of(batch, 1, SLICE_BYTES):
                yield pa.RecordBatch.from_arrays([part.column(0), loaded(path).encode_slice(part.column(1), end_id, kind)], names=[id_col, "ids"])
        pa.default_memory_pool().release_unused()  # the worker goes on to other tasks

    rows = df.select(F.col(quoted(id_col)).alias(id_col), F.col(quoted(text_col)).cast("binary").alias("__text"))
    return rows.mapInArrow(run, T.StructType([rows.schema[0], T.StructField("ids", T.BinaryType())]))
