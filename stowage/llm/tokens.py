"""Exact token ids and counts of whole texts, with each distinct piece of text encoded once per worker.

Two families of tokenizers files are known by what stands in the file. Where white space is dropped before the merges
(``word``), no token depends on what is beyond a space, so a text is cut at spaces. Where a space belongs to the word
that follows (byte-level, ``byte``), a text is cut before each space that a non-space follows and around single line
feeds between non-spaces: no pre-token reaches across such a place. Texts for any other file are not cut. Pieces keep
any other white space inside, so the library itself decides about it.

New pieces go to the library many at a time. Plain Latin words, with at most one comma or full stop at the end, are
pre-tokens whose ends show in the tokens themselves, so they are sent as one running text; others are sent one by one.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import public_tokenizers

from stowage.llm.common import slices

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
BYTE_BPE = public_tokenizers.path("byte_bpe_50k.json")

# Distinct pieces a worker remembers; beyond it, it starts anew. About 200 bytes each.
REMEMBERED = 700_000

_LATIN = [chr(code) for code in range(256)]
_LETTER = np.array([c.isalpha() for c in _LATIN])
_SPACE = np.array([c in " \t\n\v\f\r" for c in _LATIN])
_STOPS = np.array([c in ",." for c in _LATIN])


def _family(described: dict) -> str:
    """``word``, ``byte``, or ``whole`` for a file of neither family, whose texts are never cut."""
    cut = described["pre_tokenizer"] or {}
    if cut.get("type") == "ByteLevel" and cut["use_regex"] and not cut["add_prefix_space"] and not described["normalizer"]:
        return "byte"
    first = (cut.get("pretokenizers") or [{}])[0]
    if first.get("type") == "Split" and first["behavior"] == "Removed" and first["invert"]:
        # The pattern lists what is kept, and none of it is white space.
        return "word" if r"[^\s\p{L}\p{N}]+" in first["pattern"].get("Regex", "") else "whole"
    return "whole"


_BEFORE_WORD = re.compile(r" (?=\S)")


class Encoder:
    """A tokenizers file with the rule by which texts may be cut."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            described = json.load(file)
        self.kind = _family(described)
        self.special = [token["content"] for token in described["added_tokens"]]
        self.special_lowered = [token.lower() for token in self.special]
        self.lowers = self.kind == "word" and {"type": "Lowercase"} in (described["normalizer"] or {}).get("normalizers", [])
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.id_type = np.dtype("<u2") if self.size <= 1 << 16 else np.dtype("<u4")
        # Whether a token is the last of a word (word), or the first of one with its space (byte).
        self.bounds = np.zeros(self.size, dtype=bool)
        for token, at in described["model"]["vocab"].items():
            self.bounds[at] = token.endswith("</w>") if self.kind == "word" else token.startswith("\u0120")
        suffix = described["model"].get("end_of_word_suffix")
        self.joins = self.kind == "byte" or self.kind == "word" and suffix == "</w>"
        self._ids: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        """Pieces whose ids, one after another, are the ids of ``text``."""
        if self.kind == "word":
            return self._simplified(text).replace("\n", " ").split(" ")
        if self.kind == "whole" or any(token in text for token in self.special):
            # White space before a special string is grouped by where the string starts, so nothing is cut here.
            return [text]
        lines = text.split("\n") if "\n" in text else [text]
        if len(lines) > 1 and not all(line and not line[0].isspace() and not line[-1].isspace() for line in lines):
            lines = [text]
        out: list[str] = []
        for line in lines:
            if out:
                out.append("\n")
            first, *others = _BEFORE_WORD.split(line)
            out.append(first)
            out += [" " + other for other in others]
        return out

    def _simplified(self, text: str) -> str:
        """A text with the same ids and fewer distinct pieces, for a ``word`` file that lowers its letters.

        In Latin-1 nothing composes and each letter is lowered by itself. A comma or full stop after a letter and before
        white space is a pre-token of its own, so where all are such, they may be set apart.
        """
        if not self.lowers:
            return text
        try:
            codes = np.frombuffer(text.encode("latin-1"), dtype=np.uint8)
        except UnicodeEncodeError:
            return text
        lowered = text.lower()
        if any(token in lowered for token in self.special_lowered):
            return text
        at = np.flatnonzero(_STOPS[codes])
        if len(at) and at[0] and _LETTER[codes[at - 1]].all():
            after = at[:-1] if at[-1] == len(codes) - 1 else at
            if _SPACE[codes[after + 1]].all():
                return lowered.replace(",", " ,").replace(".", " .")
        return lowered

    def encode(self, pieces: Sequence[str]) -> list[list[int]]:
        return [found.ids for found in self.tokenizer.encode_batch_fast(list(pieces), add_special_tokens=False)]

    def encode_new(self, pieces: Sequence[str]) -> list[bytes]:
        """The ids of each piece, as ``encode`` gives them, with plain words sent as running text."""
        parts: list[tuple[str, str]] = []
        plain: dict[str, bytes] = {}
        other: dict[str, bytes] = {",": b"", ".": b""}
        known = self._ids
        for piece in pieces:
            tail = piece[-1:] if piece[-1:] in (",", ".") else ""
            core = piece[:-1] if tail else piece
            if self.lowers:
                core = core.lower()
            letters = core[1:] if core[:1] == " " else core
            if self.joins and letters.isalpha() and (letters.isascii() or max(letters) <= "\xff"):
                plain[core] = known.get(core, b"")
            else:
                core, tail = piece, ""
                other[core] = b""
            parts.append((core, tail))
        for piece, ids in zip(other, self.encode(list(other))):
            other[piece] = np.array(ids, dtype=self.id_type).tobytes()
        todo = [core for core, ids in plain.items() if not ids]
        spaced = [core for core in todo if core[0] == " "]
        bare = [core for core in todo if core[0] != " "]
        for words, between in ((spaced, ""), (bare, " " if self.kind == "word" else "\n")):
            found = dict(zip(words, self._running(words, between)))
            plain.update(found)
            known.update(found)
        return [(plain[core] if core in plain else other[core]) + (other[tail] if tail else b"") for core, tail in parts]

    def _running(self, words: list[str], between: str) -> list[bytes]:
        """The ids of plain words, encoded as running texts and cut where the tokens show the words' ends."""
        groups = [words[i : i + 512] for i in range(0, len(words), 512)]
        out: list[bytes] = []
        (feed,) = self.encode(["\n"])
        for group, ids in zip(groups, self.encode([between.join(group) for group in groups])):
            found = np.array(ids, dtype=self.id_type)
            if between == "\n":
                ends = np.append(np.flatnonzero(found == feed[0]), len(found))
                starts = np.append(0, ends[:-1] + 1)
            elif self.kind == "word":
                ends = np.flatnonzero(self.bounds[found]) + 1
                starts = np.append(0, ends[:-1])
            else:
                starts = np.flatnonzero(self.bounds[found])
                ends = np.append(starts[1:], len(found))
            if len(starts) != len(group):
                raise RuntimeError("the tokens of plain words do not show the words")
            raw, width = found.tobytes(), found.itemsize
            out += [raw[a * width : b * width] for a, b in zip(starts.tolist(), ends.tolist())]
        return out

    def ids(self, texts: Sequence[str]) -> list[bytes]:
        """The ids of each text as little-endian integers of ``id_type``."""
        out: list[bytes] = []
        for first, end in slices(texts):
            cut = [self.pieces(text) for text in texts[first:end]]
            wanted = set().union(*cut)
            if len(self._ids) + len(wanted) > REMEMBERED:
                # What this slice has again is likely to come again.
                self._ids = {piece: self._ids[piece] for piece in wanted if piece in self._ids}
            new = list(wanted.difference(self._ids))
            self._ids.update(zip(new, self.encode_new(new)))
            known = self._ids.__getitem__
            out.extend(b"".join(map(known, one)) for one in cut)
        return out


@lru_cache(maxsize=4)
def encoder(path: str) -> Encoder:
    """One encoder per worker process and file; it outlives the task."""
    return Encoder(path)
