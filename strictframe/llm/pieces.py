"""SentencePiece encoding and decoding through a table of distinct marked words.

No piece of the vocabulary has a whitespace mark after another character
(checked when a model is opened), so no merge crosses from a word into the next
mark.  A text therefore falls into chunks, each a run of marks and the word
after it; every distinct chunk is segmented and decoded once for each task's
table, and a text's ids are the table entries joined by position.

Defined cases: a null text is the empty text, which has no ids; repeated rows
and null ids are encoded row by row; an empty table gives an empty result;
other columns are not read.  The table is emptied when it reaches
``TABLE_CHUNKS`` entries and long chunks never enter it, so memory is bounded
whatever the corpus; that costs repeated work, never a result.
"""

from __future__ import annotations

import hashlib
import re

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import long_field, map_texts, string_field, texts_of

MARK = "▁"
TABLE_CHUNKS, TABLE_CHARS = 200_000, 64
_RUNS = re.compile(f"{MARK}+[^{MARK}]*")


def chunks(text: str) -> list[str]:
    """The marked words of a text, each without its first mark; none for the empty text."""
    if not text:
        return []
    marked = MARK + text.replace(" ", MARK)
    if MARK * 2 not in marked and marked[-1] != MARK:
        return marked.split(MARK)[1:]
    return [c[1:] for c in _RUNS.findall(marked)]


class Pieces:
    """A model and its table of distinct chunks: ids joined by commas, and decoded text."""

    def __init__(self, model_file: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        for i in range(self.model.get_piece_size()):
            if MARK in self.model.id_to_piece(i).lstrip(MARK):
                raise ValueError("a piece crosses a whitespace mark; chunks can't be segmented alone")
        self.mark_ids = [self.model.piece_to_id(MARK)]
        self.ids: dict[str, str] = {}
        self.decoded: dict[str, str] = {}

    def learn(self, new: list[str]) -> None:
        """Segment chunks.  The model's own dummy prefix stands for the first mark."""
        for chunk, ids in zip(new, self.model.encode(new, num_threads=1)):
            if not chunk:
                ids = self.mark_ids
            self.ids[chunk] = ",".join(map(str, ids))
            # Decoding drops the space of the first mark; it stands before every chunk.
            self.decoded[chunk] = " " + self.model.decode(ids)

    def encode(self, texts: list[str]) -> tuple[list[str], list[str]]:
        """Ids joined by commas, and their decoding, of each text."""
        parts = [chunks(t) for t in texts]
        if len(self.ids) > TABLE_CHUNKS:
            self.ids.clear()
            self.decoded.clear()
        new = list(set().union(*parts).difference(self.ids)) if parts else []
        self.learn(new)
        ids, decoded = self.ids, self.decoded
        out = [",".join(map(ids.__getitem__, p)) for p in parts], ["".join(map(decoded.__getitem__, p))[1:] for p in parts]
        for chunk in new:
            if len(chunk) > TABLE_CHARS:
                del ids[chunk], decoded[chunk]
        return out


def sha256_hex(text: str) -> str:
    return hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()


def encode_pieces(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col``, ``ids`` (joined by commas) and ``decoded`` of each row; one map pass."""

    def make():
        p = Pieces(model_file)

        def f(batch):
            ids, decoded = p.encode(texts_of(batch, text_col))
            return {"ids": ids, "decoded": decoded}

        return f

    return map_texts(docs, [id_col, text_col], text_col, make, [string_field("ids"), string_field("decoded")], [id_col])


def piece_digests(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The same pass, with counts and digests in place of ids and texts."""

    def make():
        p = Pieces(model_file)

        def f(batch):
            ids, decoded = p.encode(texts_of(batch, text_col))
            return {
                "n_tokens": [x.count(",") + 1 if x else 0 for x in ids],
                "ids_sha256": list(map(sha256_hex, ids)),
                "decoded_sha256": list(map(sha256_hex, decoded)),
            }

        return f

    fields: list[T.StructField] = [long_field("n_tokens"), string_field("ids_sha256"), string_field("decoded_sha256")]
    return map_texts(docs, [id_col, text_col], text_col, make, fields, [id_col])
