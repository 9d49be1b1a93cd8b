"""Byte-pair encoding of a sentencepiece model by a table of each prefix's last token.

A text's encoding ends in exactly one token, and cutting that token off leaves
the encoding of a shorter prefix.  So one table entry per prefix holds the
whole encoding of every prefix: an automaton yields the pieces that end at a
position, and the one piece is kept whose left neighbour (the last token of
the prefix before it) and itself encode, joined, to just these two.  Reading
the table backwards gives the ids; adding up along it gives the token count of
every prefix.

No piece of a supported model holds a space mark after another character, so a
text is encoded in runs ``space marks + word`` that don't affect one another;
tables of short runs are kept for reuse.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import sentencepiece

MARK = "▁"
_RUN = re.compile(f"{MARK}+[^{MARK}]*")


class PieceBpe:
    """Prefix tables for BPE models with an identity normaliser, a leading space mark and byte fallback."""

    def __init__(self, path: str):
        self.library = sp = sentencepiece.SentencePieceProcessor(model_file=path)
        if sp.normalize(" A  ﬁ ") != f"{MARK}{MARK}A{MARK}{MARK}ﬁ{MARK}":
            raise ValueError("the model's normaliser must be the identity with a leading space mark")
        ids = [i for i in range(sp.get_piece_size()) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
        pieces = {sp.id_to_piece(i): i for i in ids}
        if any(re.search(f"[^{MARK}]{MARK}", p) for p in pieces):
            raise ValueError("a piece holds a space mark after another character")
        self.bytes = [sp.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(map(sp.is_byte, self.bytes)):
            raise ValueError("the model must fall back to bytes")
        self.pieces, self.score = pieces, {p: sp.get_score(i) for p, i in pieces.items()}
        self.text = {i: p for p, i in pieces.items()}
        self.size = [len(self.text.get(i, "")) for i in range(sp.get_piece_size())]
        self.known = {p for p in pieces if len(p) == 1}
        self.automaton = ahocorasick.Automaton()
        for p, i in pieces.items():
            if self._merged(p) == [p]:  # others never come out of the encoder
                self.automaton.add_word(p, i)
        self.automaton.make_automaton()
        self.fits: dict[int, bool] = {}

    def _merged(self, text: str) -> list[str]:
        """Encoding of a short text, by merging the best pair until none is left."""
        parts, score = list(text), self.score
        while len(parts) > 1:
            best, at = None, -1
            for k in range(len(parts) - 1):
                s = score.get(parts[k] + parts[k + 1])
                if s is not None and (best is None or s > best):
                    best, at = s, k
            if best is None:
                break
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
        return parts

    def _pair(self, left: int, right: int) -> bool:
        a, b = self.text[left], self.text[right]
        if len(self.fits) >= 200_000:  # some 25 MB
            self.fits.clear()
        self.fits[left << 20 | right] = ok = self._merged(a + b) == [a, b]
        return ok

    def last_tokens(self, run: str) -> list[int]:
        """For each prefix of the run, the last token of its encoding (-1: a character in bytes)."""
        last, size, fits = [-1] * len(run), self.size, self.fits
        for end, token in self.automaton.iter(run):
            if last[end] >= 0:
                continue
            start = end - size[token]
            if start >= 0 and (before := last[start]) >= 0:
                ok = fits.get(before << 20 | token)
                if ok is None:
                    ok = self._pair(before, token)
                if not ok:
                    continue
            last[end] = token
        if -1 in last and any(t < 0 and c in self.known for t, c in zip(last, run, strict=True)):
            raise AssertionError(f"no last token for a prefix of {run!r}")
        return last

    def run_ids(self, run: str) -> bytes:
        """The run's token ids as little-endian unsigned 32-bit integers, read backwards off the table."""
        last, out, at = self.last_tokens(run), [], len(run) - 1
        while at >= 0:
            token = last[at]
            if token < 0:
                out.extend(self.bytes[b] for b in reversed(run[at].encode()))
                at -= 1
            else:
                out.append(token)
                at -= self.size[token]
        out.reverse()
        return np.array(out, "<u4").tobytes()

    def run_counts(self, run: str) -> bytes:
        """The token count of each prefix of the run, as unsigned 32-bit integers."""
        last, size, counts = self.last_tokens(run), self.size, array("I")
        for at, token in enumerate(last):
            start = at - (size[token] if token >= 0 else 1)
            counts.append((counts[start] if start >= 0 else 0) + (1 if token >= 0 else len(run[at].encode())))
        return counts.tobytes()


def runs(text: str) -> list[str]:
    """The independent runs of a text: space marks and the word after them."""
    return _RUN.findall(MARK + text.replace(" ", MARK)) if text else []


@lru_cache(maxsize=4)
def model(path: str) -> PieceBpe:
    """One set of tables for each worker process."""
    return PieceBpe(path)
