"""Unigram lattice over a SentencePiece vocabulary: exact Viterbi with SentencePiece's tie rules.

Vocabulary.  The public vocabulary file is a SentencePiece model.  Its pieces are used as they are; where the file itself is
not a unigram model (its scores are merge ranks), each piece of rank r gets the score -round(8 * ln(r + 3)), Zipf's law.
Scores are whole numbers, so sums are exact here, and in SentencePiece's 32-bit floats up to 2**24 (texts of some 600,000
characters).  ``unigram_proto`` writes the same model as a SentencePiece unigram file, against which tests compare.

Tie rules (SentencePiece's optimised unigram encoder).  Positions are visited from left to right; at each, every vocabulary
piece that starts there is a candidate for its end; an end keeps the candidate with the greatest score and, among equals, the
one with the earliest start (the longest piece).  A character that no single-character piece covers is also an unknown piece
with the least score minus ten; an unknown piece is written as one byte piece for each of its UTF-8 bytes.

Cuts.  A piece holds the space mark only as a prefix (checked on loading), so no piece crosses the place between another
character and a space mark.  A text therefore falls apart into units (spaces and what follows), which are independent.
"""

from __future__ import annotations

import math
import re
import struct
from collections.abc import Callable
from itertools import chain
from typing import NamedTuple

import ahocorasick
import numpy as np

SPACE = "▁"
_UNIT = re.compile(rb" *[^ ]+| +$")
_NEVER = -(10**15)


def _fields(buf: bytes):
    at = 0
    while at < len(buf):
        key, at = _varint(buf, at)
        if key & 7 == 0:
            value, at = _varint(buf, at)
        elif key & 7 == 5:
            value, at = buf[at : at + 4], at + 4
        elif key & 7 == 1:
            value, at = buf[at : at + 8], at + 8
        else:
            size, at = _varint(buf, at)
            value, at = buf[at : at + size], at + size
        yield key >> 3, key & 7, value


def _varint(buf: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        b = buf[at]
        value |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return value, at


def _put(number: int, kind: int, value) -> bytes:
    def varint(x: int) -> bytes:
        out = bytearray()
        while x > 127:
            out.append(x & 127 | 128)
            x >>= 7
        return bytes([*out, x])

    body = varint(value) if kind == 0 else value if kind in (1, 5) else varint(len(value)) + value
    return varint(number << 3 | kind) + body


#: SentencePiece's piece types and unigram model type (fixed values of its file format).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
UNIGRAM = 1


def read_model(path: str) -> tuple[list[tuple[str, float, int]], int, bytes]:
    """Pieces (text, score, type), model type, and the file's bytes."""
    raw = open(path, "rb").read()
    pieces, model_type = [], UNIGRAM
    for number, _, value in _fields(raw):
        if number == 1:
            f = {n: v for n, _, v in _fields(value)}
            pieces.append((f[1].decode(), struct.unpack("<f", f[2])[0] if 2 in f else 0.0, f.get(3, NORMAL)))
        elif number == 2:
            model_type = {n: v for n, _, v in _fields(value)}.get(3, UNIGRAM)
    return pieces, model_type, raw


def scores(pieces: list[tuple[str, float, int]], model_type: int) -> list[float]:
    if model_type == UNIGRAM:
        return [s for _, s, _ in pieces]
    return [float(-round(8 * math.log(r + 3))) if kind == NORMAL else 0.0 for r, (_, _, kind) in enumerate(pieces)]


def unigram_proto(path: str) -> bytes:
    """The same vocabulary as a SentencePiece unigram model."""
    pieces, model_type, raw = read_model(path)
    own, out, k = scores(pieces, model_type), bytearray(), 0
    for number, kind, value in _fields(raw):
        if number == 1:
            value = b"".join(_put(n, t, struct.pack("<f", own[k]) if n == 2 else v) for n, t, v in _fields(value))
            k += 1
        elif number == 2:
            value = b"".join(_put(n, t, UNIGRAM if n == 3 else v) for n, t, v in _fields(value))
        out += _put(number, kind, value)
    return bytes(out)


#: Units of more characters than this have a lattice of their own; common lattices take about so many characters.
UNIT, LATTICE = 64, 200_000


class Paths(NamedTuple):
    """Lattices of units side by side; ``first`` and ``last`` are the places of each unit's ends."""

    units: list[str]
    first: np.ndarray
    last: np.ndarray
    best: np.ndarray
    back: np.ndarray | None
    count: np.ndarray

    def trace(self, id_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Pieces of all best paths, where each unit's begin, and the units (perhaps repeated) with an unknown character."""
        steps, unit, place = [], np.arange(len(self.units)), self.last
        n = np.zeros(len(self.units), np.int64)
        while len(unit):
            won = self.back[place]
            steps.append((unit, (won & (1 << id_bits) - 1) - 1))
            n[unit] += 1
            place = place - (won >> id_bits)
            alive = place > self.first[unit]
            unit, place = unit[alive], place[alive]
        cuts = np.concatenate(([0], np.cumsum(n)))
        ids = np.empty(cuts[-1], np.int64)
        for k, (unit, piece) in enumerate(steps):
            ids[cuts[unit + 1] - 1 - k] = piece
        return ids, cuts, np.concatenate([u[p < 0] for u, p in steps]) if steps else unit


class Unigram:
    """Encoder, counter and decoder.  Strings here are marked: spaces are already space marks."""

    def __init__(self, path: str, limit: int = 150_000):
        pieces, model_type, _ = read_model(path)
        own = scores(pieces, model_type)
        self.text = [p for p, _, _ in pieces]
        self.kind = [k for _, _, k in pieces]
        normal = [(i, p, own[i]) for i, (p, _, k) in enumerate(pieces) if k in (NORMAL, USER_DEFINED)]
        if any(SPACE in p.lstrip(SPACE) for _, p, _ in normal):
            raise ValueError("a piece holds the space mark after another character")
        if any(s != round(s) for _, _, s in normal):
            raise ValueError("scores must be whole numbers")
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.unknown_id = next(i for i, (_, _, k) in enumerate(pieces) if k == UNKNOWN)
        self.unknown_score = int(min(s for _, _, s in normal)) - 10
        self.longest = max(len(p) for _, p, _ in normal)
        self.single = {p for _, p, _ in normal if len(p) == 1}
        self.piece_size = np.array([len(p) for p, _, _ in pieces], np.int64)
        self.piece_score = np.array(own, np.float64).astype(np.int64)
        self.size_of, self.score_of = self.piece_size.tolist(), self.piece_score.tolist()
        self.id_bits = len(pieces).bit_length()
        self.matcher = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for i, p, _ in normal:
            self.matcher.add_word(p, i)
        self.matcher.make_automaton()
        self.limit, self.memory, self.passing = limit, {}, ()

    def lattice(self, text: str, seeds: dict[int, int] | None = None, stop: int | None = None, strict: bool = False) -> tuple[list[int], list[int], list[int]]:
        """Best score, id and start of the last piece for each end position.

        ``seeds`` gives scores of positions where paths may begin (position 0 with score 0 by default).  Pieces that start
        at or after ``stop`` are left out.  With ``strict``, scores at seeds are final: pieces do not end there.
        """
        n = len(text)
        stop = n if stop is None else stop
        best, last, start = [_NEVER] * (n + 1), [-1] * (n + 1), [-1] * (n + 1)
        for at, score in (seeds or {0: 0}).items():
            best[at] = score
        fixed = set(seeds) if strict and seeds else ()
        unknown, single, floor = self.unknown_score, self.single, self.unknown_id
        done = 0

        def gaps(upto: int) -> None:  # unknown characters that end before the next match
            nonlocal done
            while done < upto:
                if done < stop and best[done] > _NEVER and text[done] not in single and done + 1 not in fixed:
                    s = best[done] + unknown
                    if s > best[done + 1] or (s == best[done + 1] and done < start[done + 1]):
                        best[done + 1], last[done + 1], start[done + 1] = s, floor, done
                done += 1

        # the automaton reports ends in ascending order, at each end the longest piece first: the earliest start wins ties
        size_of, score_of = self.size_of, self.score_of
        for end, i in self.matcher.iter(text):
            end += 1
            if end > done + 1:
                gaps(end - 1)
            at = end - size_of[i]
            if at < 0 or at >= stop or end in fixed or best[at] == _NEVER:
                continue
            s = best[at] + score_of[i]
            if s > best[end] or (s == best[end] and at < start[end]):
                best[end], last[end], start[end] = s, i, at
            if done < end - 1:
                gaps(end - 1)
        gaps(n)
        return best, last, start

    def pieces_of(self, last: int, text: str) -> list[int]:
        """Ids of one lattice piece: an unknown character becomes its bytes."""
        return [self.byte_id[b] for b in text.encode()] if last == self.unknown_id and self.byte_id else [last]

    def backtrace(self, text: str, lattice: tuple[list[int], list[int], list[int]], end: int) -> tuple[list[int], int]:
        """Ids of the best path to ``end``, and the position where it begins."""
        _, last, start = lattice
        back = []
        while start[end] >= 0:
            back.append(self.pieces_of(last[end], text[start[end] : end]))
            end = start[end]
        return [i for x in reversed(back) for i in x], end

    def ids(self, text: str) -> list[int]:
        return self.backtrace(text, self.lattice(text), len(text))[0]

    def ids_and_score(self, text: str) -> tuple[list[int], int]:
        lattice = self.lattice(text)
        return self.backtrace(text, lattice, len(text))[0], lattice[0][-1]

    def count(self, text: str) -> tuple[int, int]:
        """Number of ids and score of the best path: both are carried along the text, without back pointers or ids."""
        n, unknown, single = len(text), self.unknown_score, self.single
        best, count = [_NEVER] * (n + 1), [0] * (n + 1)
        best[0], done, size_of, score_of = 0, 0, self.size_of, self.score_of

        def gaps(upto: int) -> None:
            nonlocal done
            while done < upto:
                if text[done] not in single and best[done] + unknown > best[done + 1]:
                    best[done + 1] = best[done] + unknown
                    count[done + 1] = count[done] + (len(text[done].encode()) if self.byte_id else 1)
                done += 1

        # the longest piece of an end comes first, the unknown character last: what comes later must be better to win
        for end, i in self.matcher.iter(text):
            end += 1
            if end > done + 1:
                gaps(end - 1)
            at = end - size_of[i]
            if (s := best[at] + score_of[i]) > best[end]:
                best[end], count[end] = s, count[at] + 1
        gaps(n)
        return count[n], best[n]

    def counts(self, units: list[str]) -> list[tuple[int, int]]:
        """``count`` of many independent units."""
        return self._many(units, self.count, lambda paths: list(zip(paths.count[paths.last].tolist(), paths.best[paths.last].tolist(), strict=True)), False)

    def ids_and_scores(self, units: list[str]) -> list[tuple[bytes, int]]:
        """Ids (int32 bytes) and score of many independent units."""

        def one(unit: str) -> tuple[bytes, int]:
            ids, score = self.ids_and_score(unit)
            return np.array(ids, np.int32).tobytes(), score

        def traced(paths: Paths) -> list[tuple[bytes, int]]:
            ids, cuts, unknown = paths.trace(self.id_bits)
            raw, score = ids.astype(np.int32).tobytes(), paths.best[paths.last].tolist()
            out = [(raw[4 * a : 4 * b], s) for a, b, s in zip(cuts[:-1].tolist(), cuts[1:].tolist(), score, strict=True)]
            for u in np.unique(unknown).tolist():
                out[u] = one(paths.units[u])
            return out

        return self._many(units, one, traced, True)

    def _many(self, units: list[str], one: Callable, of_paths: Callable, traced: bool) -> list:
        """Values of units: those of usual length through common lattices of bounded size, the others one by one."""

        def close() -> None:
            for at, v in zip(block, of_paths(self._paths([units[b] for b in block], traced)), strict=True):
                out[at] = v

        out: list = [None] * len(units)
        block, size = [], 0
        for k, unit in enumerate(units):
            if len(unit) > UNIT or unit.endswith(SPACE):
                out[k] = one(unit)
                continue
            block.append(k)
            size += len(unit)
            if size >= LATTICE:
                close()
                block, size = [], 0
        if block:
            close()
        return out

    def _paths(self, units: list[str], traced: bool) -> Paths:
        """The lattices of many units side by side: one automaton run, then one step for each length of a prefix.

        No piece crosses from one unit into the next, since only its first character can be a space mark.
        """
        text = "".join(units)
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        found = np.fromiter(chain.from_iterable(self.matcher.iter(text)), np.int64).reshape(-1, 2)
        last, piece = found[:, 0], found[:, 1]  # place of a piece's last character
        single = np.zeros(len(text), bool)
        single[last[self.piece_size[piece] == 1]] = True
        unknown = np.flatnonzero(~single)
        if len(unknown):
            last, piece = np.concatenate((last, unknown)), np.concatenate((piece, np.full(len(unknown), -1)))
            order = np.argsort(last, kind="stable")
            last, piece = last[order], piece[order]
        size = np.where(piece < 0, 1, self.piece_size[piece])
        score = np.where(piece < 0, self.unknown_score, self.piece_score[piece])
        unit = np.repeat(np.arange(len(units)), sizes)
        start = np.cumsum(sizes) - sizes
        depth = last + 1 - start[unit[last]]  # characters of the unit up to the piece's end
        order = np.argsort(depth.astype(np.uint8), kind="stable")
        depth, last, score, size = depth[order], last[order], score[order], size[order]
        low = size << self.id_bits | (piece[order] + 1)
        place = last + 1 + unit[last]  # a unit of n characters has n + 1 places
        groups = np.flatnonzero(np.concatenate(([True], place[1:] != place[:-1])))
        ends = place[groups]
        more = np.zeros(len(text) + len(units), np.int64)
        if len(unknown) and self.byte_id:
            more[unknown + 1 + unit[unknown]] = [len(text[k].encode()) - 1 for k in unknown.tolist()]
        best, count = (np.zeros(len(text) + len(units), np.int64) for _ in range(2))
        back = np.zeros_like(best) if traced else None
        bits = self.id_bits + 8
        steps = np.searchsorted(depth, np.arange(1, int(sizes.max(initial=0)) + 2))
        of_step = np.searchsorted(groups, steps)
        for a, b, g, h in zip(steps[:-1].tolist(), steps[1:].tolist(), of_step[:-1].tolist(), of_step[1:].tolist(), strict=True):
            value = (best[place[a:b] - size[a:b]] + score[a:b] << bits) + low[a:b]  # among equal scores the longest piece wins
            value = np.maximum.reduceat(value, groups[g:h] - a)
            end, won = ends[g:h], value & (1 << bits) - 1
            length = won >> self.id_bits
            best[end] = value >> bits
            if traced:
                back[end] = won
            count[end] = count[end - length] + 1 + np.where(won & (1 << self.id_bits) - 1, 0, more[end])
        first = start + np.arange(len(units))
        return Paths(units, first, first + sizes, best, back, count)

    def units(self, text: bytes) -> list[bytes]:
        """The independent units of a text with its added first space; spaces are still spaces."""
        if not text:
            return []
        if b"  " not in text and b"\xe2\x96\x81" not in text and text[:1] != b" " and text[-1:] != b" ":
            return text.split(b" ")  # each unit's one leading space is left to mark()
        return _UNIT.findall(b" " + text.replace(SPACE.encode(), b" "))

    @staticmethod
    def mark(unit: bytes) -> str:
        """A unit as a marked string; a unit without a leading space had its one space split off."""
        s = unit.decode().replace(" ", SPACE)
        return s if s.startswith(SPACE) else SPACE + s

    def remember(self, units: list[list[bytes]], values: Callable[[list[str]], list]) -> dict:
        """Values of all units, from memory or by ``values(marked strings)``; they hold until the next call."""
        known = self.memory
        for unit in self.passing:  # of the last call: the memory was full
            del known[unit]
        missing = set().union(*units).difference(known)
        known.update(zip(missing, values([self.mark(u) for u in missing]), strict=True))
        self.passing = missing if len(known) > self.limit else ()
        return known

    def decode(self, ids) -> str:
        """Text of ids: bytes are joined, space marks become spaces, the added first space goes."""
        out = bytearray()
        for i in ids:
            out += bytes([int(self.text[i][3:5], 16)]) if self.kind[i] == BYTE else self.text[i].encode()
        s = out.decode("utf-8", "replace").replace(SPACE, " ")
        return s[1:] if s.startswith(" ") else s

    def byte_table(self) -> tuple[np.ndarray, np.ndarray]:
        """All pieces' output bytes in one array, and where each begins: for decoding many ids at once."""
        parts = [bytes([int(p[3:5], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(self.text, self.kind, strict=True)]
        return np.frombuffer(b"".join(parts), np.uint8), np.concatenate(([0], np.cumsum([len(p) for p in parts])))
