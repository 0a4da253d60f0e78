"""Exact merge-type encoding of a SentencePiece BPE model by backtracking.

An Aho-Corasick automaton lists the pieces that match at each position.  From
the left the longest match is tried first; a piece is accepted if it and its
predecessor are compatible, that is, if merging their characters anew gives
just these two.  A position from which nothing continues is marked in a
bitfield and never entered again.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from functools import cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.llm.arrow import map_slices

SPACE = "▁"
CACHED_SEGMENTS = 500_000
CACHED_PAIRS = 500_000


class PieceEncoder:
    """Encoder and decoder over the vocabulary of a BPE model with byte fallback."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bos, self.eos = model.bos_id(), model.eos_id()
        self.ids: dict[str, int] = {}
        self.scores: dict[str, float] = {}
        self.byte_ids = [0] * 256
        self.surface: list[bytes] = []
        self.automaton = ahocorasick.Automaton()
        for i in range(model.vocab_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.surface.append(bytes([int(piece[3:5], 16)]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.surface.append(b"")
            else:
                self.ids[piece] = i
                self.scores[piece] = model.get_score(i)
                self.surface.append(piece.replace(SPACE, " ").encode())
                self.automaton.add_word(piece, len(piece))
        self.automaton.make_automaton()
        self.shorter = {piece: self._next_shorter(piece) for piece in self.ids if len(piece) > 1}
        self.segment = self._boundaries()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def _next_shorter(self, piece: str) -> str:
        """The longest proper prefix that is a piece, else the first character."""
        return next((piece[:n] for n in range(len(piece) - 1, 1, -1) if piece[:n] in self.ids), piece[0])

    def _boundaries(self) -> re.Pattern:
        """Where to cut: only between characters that stand side by side in no piece, so no merge is lost.

        Cuts come before a run of spaces, around line feeds, and between
        letters and other characters, each only if the vocabulary allows it.
        """
        feed = "" if any("\n" in piece for piece in self.ids) else "\n"
        if any(SPACE in piece.lstrip(SPACE) for piece in self.ids):
            return re.compile(f"{feed}|[^{feed}]+" if feed else ".+", re.DOTALL)
        letter = r"[^\W\d_]"
        across = re.compile(f"{letter}(?!{SPACE})[\\W\\d_]|(?!{SPACE})[\\W\\d_]{letter}")
        if any(across.search(piece) for piece in self.ids):
            own = f"{SPACE}*[^{SPACE}{feed}]+"
        else:
            own = f"{SPACE}*{letter}+|{SPACE}*(?:(?![{SPACE}{feed}])[\\W\\d_])+"
        return re.compile("|".join([own, f"{SPACE}+", *feed]))

    def _merged(self, text: str) -> list[str]:
        """Merge adjacent symbols, highest score first and leftmost among equals, until no pair is a piece."""
        parts, scores = list(text), self.scores
        while len(parts) > 1:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _compatible(self, left: str, right: str) -> bool:
        """Whether merging the two pieces' characters anew leaves exactly them (left empty: only the right one)."""
        found = self.pairs.get((left, right))
        if found is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            found = self.pairs[left, right] = self._merged(left + right) == ([left, right] if left else [right])
        return found

    def split(self, text: str) -> list[str]:
        """Pieces of one segment; a character outside the vocabulary stands for itself."""
        longest = [1] * len(text)
        for end, length in self.automaton.iter(text):
            longest[end - length + 1] = length
        pairs, shorter = self.pairs, self.shorter
        failed, at, last = 0, 0, ""
        taken: list[str] = []
        piece = text[: longest[0]]
        while True:
            while piece:
                end = at + len(piece)
                if not failed >> end & 1:
                    fits = pairs.get((last, piece))
                    if fits or (fits is None and self._compatible(last, piece)):
                        break
                piece = shorter.get(piece, "")
            if piece:
                taken.append(piece)
                if end == len(text):
                    return taken
                at, last, piece = end, piece, text[end : end + longest[end]]
            else:
                failed |= 1 << at
                piece = taken.pop()
                at -= len(piece)
                last = taken[-1] if taken else ""
                piece = shorter.get(piece, "")

    def _ids(self, segment: str) -> list[int]:
        pieces = self.split(segment)
        found = list(map(self.ids.get, pieces))
        if None in found:
            found = [i for p in pieces for i in ([self.ids[p]] if p in self.ids else map(self.byte_ids.__getitem__, p.encode()))]
        return found

    def _surface(self, ids: list[int]) -> str:
        return b"".join(map(self.surface.__getitem__, ids)).decode("utf-8", "replace")

    def _look_up(self, segment: str, odd: dict[str, str]) -> bytes:
        """Ids of a segment.  Two tables take turns: what is still used moves on when the younger one is full.

        Every new segment is decoded as well.  One whose surface is not its own
        text goes to ``odd`` and is not remembered.
        """
        value = self.known.get(segment) or self.older.get(segment)
        if value is None:
            ids = self._ids(segment)
            value = array("I", ids).tobytes()
            surface = self._surface(ids)
            if surface != segment.replace(SPACE, " "):
                odd[segment] = surface
                return value
        if len(self.known) >= CACHED_SEGMENTS:
            self.older, self.known = self.known, {}
        self.known[segment] = value
        return value

    def round_trip(self, text: str) -> tuple[np.ndarray, str]:
        """The ids with begin and end of sentence, and what they decode to.

        Decoding joins the pieces' surfaces and drops the blank put before the text.
        """
        cut = self.segment.findall(SPACE + text.replace(" ", SPACE)) if text else []
        odd: dict[str, str] = {}
        found = list(map(self.known.get, cut))
        if None in found:
            found = [self._look_up(s, odd) if v is None else v for s, v in zip(cut, found, strict=True)]
        body = np.frombuffer(b"".join(found), np.uint32)
        decoded = "".join([odd.get(s, s) for s in cut] if odd else cut).replace(SPACE, " ")
        ids = np.concatenate([[self.bos], body, [self.eos]]).astype("<u4")
        return ids, decoded[1:] if decoded.startswith(" ") else decoded


@cache
def piece_encoder(model_file: str) -> PieceEncoder:
    """The encoder of this Python worker; its look-up tables are bounded and live as long as the worker."""
    return PieceEncoder(model_file)


def encode_documents(
    documents: DataFrame, model_file: str, doc_id: str = "doc_id", text: str = "text", with_ids: bool = True
) -> DataFrame:
    """Encode and decode every text.

    Returns ``doc_id``, ``ids`` (array, if ``with_ids``), ``decoded`` (likewise),
    ``n_tokens``, ``ids_sha256`` and ``decoded_sha256``.  A null text is encoded
    as the empty one: begin and end ids only.  Each row stands alone: ids may be
    null or repeat, order and partitioning play no part.
    """
    source = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    kind = source.schema["doc_id"].dataType.simpleString()

    def make():
        encoder = piece_encoder(model_file)

        def apply(part: pa.RecordBatch) -> dict:
            made = [encoder.round_trip(t or "") for t in part.column("text").to_pylist()]
            columns = {"doc_id": part.column("doc_id")}
            if with_ids:
                columns["ids"] = pa.array([ids.astype("i4") for ids, _ in made], pa.list_(pa.int32()))
                columns["decoded"] = pa.array([decoded for _, decoded in made], pa.string())
            columns["n_tokens"] = pa.array([len(ids) for ids, _ in made], pa.int64())
            columns["ids_sha256"] = pa.array([hashlib.sha256(ids.tobytes()).hexdigest() for ids, _ in made], pa.string())
            columns["decoded_sha256"] = pa.array(
                [hashlib.sha256(decoded.encode()).hexdigest() for _, decoded in made], pa.string()
            )
            return columns

        return apply

    kept = "ids array<int>, decoded string, " if with_ids else ""
    made = map_slices(
        source, "text", f"doc_id {kind}, {kept}n_tokens bigint, ids_sha256 string, decoded_sha256 string", make
    )
    return made.withColumnRenamed("doc_id", doc_id)
