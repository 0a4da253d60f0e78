"""Byte-level BPE ids of whole texts.

Texts of plain characters go whole to ``tiktoken`` with the ranks of the
tokenizer's own vocabulary: both libraries split them alike and merge the pair
of lowest rank first, and nothing of them is remembered.  All others are cut.

No merge crosses the start of white space, nor the end of a run of letters
and digits before punctuation, because the pre-tokenizer always cuts there.  So
a text is cut at those places and the ids of its segments are looked up; only
segments not met before are encoded.  Two tables take turns, so that what is in
use stays known while memory is bounded.

New segments of plain characters go to ``tiktoken`` too.  All others (special
tokens, other scripts, whose classes may differ between Unicode versions, other
white space) go through ``tokenizers``.
"""

from __future__ import annotations

import json
import os
import re
import struct
from functools import cache

import numpy as np

#: The characters of Unicode's White_Space property.
WHITE = " \t\n\r\x0b\x0c\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: ASCII punctuation, never part of a letter or number run.
MARKS = re.escape("!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")
SEGMENT = re.compile(f"[{WHITE}]*(?:[^\\W_]++(?=[{MARKS}])|[^{WHITE}]+)|[{WHITE}]+")
#: Segments that both libraries split alike: a blank at most, then printable ASCII and Latin letters.
PLAIN = re.compile(" ?[!-~\xa1-\xac\xae-\u024f]+")
#: Texts that both libraries split alike as a whole; longer ones are cut, since splitting a run of white space may backtrack.
WHOLE = re.compile("[ \t\n\r!-~\xa1-\xac\xae-\u024f]*+")
WHOLE_CHARS = 1 << 18
#: Fixed value: how a byte-level pre-tokenizer splits a text.
SPLIT = r"'(?:s|t|re|ve|m|ll|d)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
CACHED_SEGMENTS = 100_000


def byte_characters() -> dict[str, int]:
    """The character that stands for each byte in a byte-level vocabulary: itself if printable, else the next from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    return {chr(b): b for b in printable} | {chr(256 + at): b for at, b in enumerate(others)}


def ranked_encoder(path: str):
    """A ``tiktoken`` encoding of the same ids, or None if the tokenizer is not plain byte-level BPE with ids in merge order."""
    import tiktoken

    with open(path, encoding="utf-8") as file:
        given = json.load(file)
    model, before = given["model"], given.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not model.get("dropout") and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix")
    split = before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space")
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]] if plain else []
    letters = byte_characters()
    in_order = all(model["vocab"].get(a + b) == 256 + at for at, (a, b) in enumerate(pairs)) and sorted(model["vocab"].get(c, -1) for c in letters) == list(range(256))
    if not (plain and split and in_order) or given.get("normalizer"):
        return None
    tokens = [*letters, *(a + b for a, b in pairs)]
    ranks = {bytes(letters[c] for c in token): model["vocab"][token] for token in tokens}
    return tiktoken.Encoding("ranked", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})


class SegmentIds:
    """Ids of texts as ``numpy.uint32`` arrays.

    A special token's string in a text gives the special token, as in the library; with ``plain_specials`` it is ordinary text.
    No segment ends inside ``<|endoftext|>``: a segment that holds its first mark goes on to the next white space.
    """

    def __init__(self, path: str, plain_specials: bool = False):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain_specials
        self.ranked = ranked_encoder(path)
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        whole = [self._is_whole(text) for text in texts]
        others = iter(self._by_segment([text for text, is_whole in zip(texts, whole, strict=True) if not is_whole]))
        return [
            np.array(self.ranked.encode_ordinary(text), "<u4") if is_whole else next(others)
            for text, is_whole in zip(texts, whole, strict=True)
        ]

    def _is_whole(self, text: str) -> bool:
        return bool(self.ranked and len(text) <= WHOLE_CHARS and "<|" not in text and WHOLE.fullmatch(text))

    def _by_segment(self, texts: list[str]) -> list[np.ndarray]:
        cut = [SEGMENT.findall(text) for text in texts]
        if len(self.known) >= CACHED_SEGMENTS:
            self.older, self.known = self.known, {}
        known = self.known
        ids = [list(map(known.get, segments)) for segments in cut]
        gaps = []
        for segments, found in zip(cut, ids, strict=True):
            at = -1
            for _ in range(found.count(None)):
                at = found.index(None, at + 1)
                gaps.append((found, at, segments[at]))
        self._learn({segment for _, _, segment in gaps})
        for found, at, segment in gaps:
            found[at] = known[segment]
        return [np.frombuffer(b"".join(found), "<u4") for found in ids]

    def _learn(self, segments: set[str]) -> None:
        known, older, rest = self.known, self.older, []
        for segment in segments:
            if segment in older:
                known[segment] = older[segment]
            elif self.ranked and "<|" not in segment and PLAIN.fullmatch(segment):
                made = self.ranked.encode_ordinary(segment)
                known[segment] = struct.pack(f"<{len(made)}I", *made)
            else:
                rest.append(segment)
        for at in range(0, len(rest), 4096):
            part = rest[at : at + 4096]
            for segment, made in zip(part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False), strict=True):
                known[segment] = struct.pack(f"<{len(made)}I", *made.ids)


@cache
def segment_ids(path: str, plain_specials: bool = False) -> SegmentIds:
    """The encoder of this Python worker; its look-up table lives as long as the worker."""
    return SegmentIds(path, plain_specials)
