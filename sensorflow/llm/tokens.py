"""Token ids of whole texts, by a tokenizer file of the tokenizers library."""

from __future__ import annotations

import os
import re

from sensorflow.llm.staging import worker_memo

ANYWHERE = re.compile(r"(?<=\S)(?= \S)")
# Letters that no normal form or lower-casing turns into a letter and a mark: Latin, Greek, Cyrillic, kana, Han, Hangul.
LETTERS = "A-Za-zÀ-ÖØ-öø-įĲ-ɏΑ-ΡΣ-Ωα-ωЀ-ҁҊ-ԯぁ-ゖァ-ヺ一-鿿가-힣"
PLAIN = re.compile(rf"[0-9{LETTERS}!-/:-@\[-`{{-~ \n]*")
ADJACENT = ("  ", " \n", "\n ", "\n\n")
PIECE = re.compile(r"\n| ?(?:[^\w \n]|_)*[^\W_]*")
CUT = "\0"  # stands in no plain text
# One of these between plain pieces is a token of its own in the given files, so that many pieces are encoded in one call.
MARKS = ("\n", " \x01 ")
SAMPLES = ["word", " word", ",", " ;x", "9", " -", "_"]
MAX_PIECES = 600_000


class Generations:
    """Values that were used lately: when the young ones are ``most``, they become the old ones; what is used again is young again."""

    def __init__(self, most: int):
        self.most, self.young, self.old = most, {}, {}

    def ready(self) -> dict:
        """The young ones; they stay so until the next call."""
        if len(self.young) >= self.most:
            self.young, self.old = {}, self.young
        return self.young

    def unknown(self, keys: set) -> list:
        """Those of ``keys``, none of them young, that are not old; the others become young."""
        new = []
        for key in keys:
            value = self.old.get(key)
            if value is None:
                new.append(key)
            else:
                self.young[key] = value
        return new


class Encoder:
    """Encodes texts piece by piece, cut where the pre-tokenizers of the given files always cut.

    Texts of letters, digits, ASCII punctuation and single spaces or line ends are cut before spaces and line ends into chunks, and new
    chunks after line ends and between a letter or digit and punctuation into pieces; other texts only before a single space between two
    other characters. So the ids of the pieces put together are the ids of the text. Chunks and pieces repeat: each is encoded once, many in one call, and
    kept for all tasks of the worker while it is used, in two generations of at most MAX_PIECES and one text's (about 250 MB). Special tokens written in a text are ordinary text.
    """

    def __init__(self, path: str, dtype: str = "<u4"):
        import numpy as np
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.array, self.dtype = np.array, np.dtype(dtype)
        if self.tokenizer.get_vocab_size() > 2 ** (8 * self.dtype.itemsize):
            raise ValueError(f"{dtype} is too small for {self.tokenizer.get_vocab_size()} ids")
        self.mark = next((mark for mark in MARKS if self._cuts(mark)), None)
        self._mark_id = self._encoded([self.mark])[0][0] if self.mark else None
        self.pieces = worker_memo().setdefault(("ids", path, dtype), Generations(MAX_PIECES))

    def _encoded(self, texts: list[str]) -> list:
        return [self.array(found.ids, self.dtype) for found in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _cuts(self, mark: str) -> bool:
        """Whether ``mark`` has one id and texts on both sides of it have their own ids."""
        alone = self._encoded([mark])[0]
        joined, apart = self._encoded([mark.join(SAMPLES)])[0].tolist(), [ids.tolist() for ids in self._encoded(SAMPLES)]
        return len(alone) == 1 and joined == [i for part in apart for i in [*part, int(alone[0])]][:-1]

    def _encoded_together(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of plain pieces, 100 pieces between marks encoded as one text."""
        out, width = {}, self.dtype.itemsize
        other = [piece for piece in pieces if not self.mark or not piece or piece == "\n"]
        plain = [piece for piece in pieces if piece and piece != "\n"] if self.mark else []
        for first in range(0, len(plain), 100):
            block = plain[first : first + 100]
            ids = self._encoded([self.mark.join(block)])[0]
            marks = (ids == self._mark_id).nonzero()[0]
            if len(marks) != len(block) - 1:
                other += block
                continue
            raw = ids.tobytes()
            for piece, begin, end in zip(block, [0, *((marks + 1) * width).tolist()], [*(marks * width).tolist(), len(raw)]):
                out[piece] = raw[begin:end]
        return out | self._encoded_apart(other)

    def _encoded_apart(self, pieces: list[str]) -> dict[str, bytes]:
        return {piece: ids.tobytes() for piece, ids in zip(pieces, self._encoded(pieces))} if pieces else {}

    def _learned(self, chunks: list[str], plain: bool) -> dict[str, bytes]:
        """Known ids, among them those of all ``chunks``. A new plain chunk is put together of its pieces, which other chunks share."""
        young = self.pieces.ready()
        new = self.pieces.unknown(set(chunks).difference(young))
        if not plain:
            young.update(self._encoded_apart(new))
        elif new:
            parts = {chunk: PIECE.findall(chunk) for chunk in new}
            wanted = {piece for found in parts.values() for piece in found}
            young.update(self._encoded_together(self.pieces.unknown(wanted.difference(young))))
            for chunk, found in parts.items():
                if chunk not in young:
                    young[chunk] = b"".join([young[piece] for piece in found])
        return young

    def ids(self, text: str | None) -> bytes:
        """The ids of a text as bytes of ``dtype``; none for a null or empty text."""
        if not text:
            return b""
        plain = bool(PLAIN.fullmatch(text)) and text[0] not in " \n" and text[-1] not in " \n" and not any(pair in text for pair in ADJACENT)
        chunks = text.replace(" ", CUT + " ").replace("\n", CUT + "\n").split(CUT) if plain else ANYWHERE.split(text)
        return b"".join(map(self._learned(chunks, plain).__getitem__, chunks))
