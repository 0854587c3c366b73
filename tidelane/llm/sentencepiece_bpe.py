"""SentencePiece model files of the BPE type, and words by merges.

The score of a piece in such a file is its negated merge rank. A text begins as single characters, and the two
neighbours that form the piece of highest score are joined, the leftmost first among equals, until no two
neighbours form a piece. A merge gives a piece, so none reaches over a place that no piece crosses: words (see
``Model.words``) are merged apart, and many of them side by side.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterable
from functools import cached_property

import numpy as np

MARK = "\u2581"
SIDE_BY_SIDE = 64  # characters of the longest words that are merged together
WORD_CACHE = 100_000  # words and pairs of pieces that a task remembers


class Model:
    """Pieces, scores and the places that no piece crosses, from a SentencePiece model file of the BPE type."""

    def __init__(self, path: str) -> None:
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        norm = proto.normalizer_spec
        if norm.precompiled_charsmap or norm.remove_extra_whitespaces or not norm.escape_whitespaces or not norm.add_dummy_prefix:
            raise ValueError("only identity normalisation with a dummy prefix is supported")
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or proto.trainer_spec.treat_whitespace_as_suffix or any(p.type in (4, 5) for p in proto.pieces):
            raise ValueError("only BPE models with byte fallback and without user-defined or unused pieces are supported")
        self.ids: dict[str, int] = {}
        self.scores: list[float] = []
        self.pieces: list[bytes] = []
        self.byte_ids = [0] * 256
        for i, p in enumerate(proto.pieces):
            self.scores.append(p.score)
            self.pieces.append(b"" if p.type in (2, 3) else p.piece.replace(MARK, " ").encode())
            if p.type == 6:
                b = int(p.piece[3:5], 16)
                self.byte_ids[b] = i
                self.pieces[-1] = bytes([b])
            elif p.type == 1:
                self.ids[p.piece] = i
        self.longest = max(map(len, self.ids), default=1)
        if self.longest >= 128:
            raise ValueError("pieces of 128 characters and more are not supported")
        # words are cut before spaces and where letters, digits and other characters meet, if every piece lies within
        # one such word; else before spaces only, or not at all
        self.by_word = not any(MARK in p.lstrip(MARK) for p in self.ids)
        fine = re.compile(rf"{MARK}*[^\W\d_]+|{MARK}*[^{MARK}\w]+|{MARK}*[\d_]+|{MARK}+", re.DOTALL)
        coarse = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
        self.words = (fine if all(map(fine.fullmatch, self.ids)) else coarse) if self.by_word else re.compile(r"(?s).+")
        self.known: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[str, str], bool] = {}

    def merged(self, s: str) -> list[str]:
        """The pieces of a string, by a queue of its neighbours; characters that are no pieces stay as they are."""
        ids, scores = self.ids, self.scores
        part, after, before = list(s), [*range(1, len(s)), -1], list(range(-1, len(s) - 1))
        queue: list[tuple[float, int, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            if a >= 0 and b >= 0 and (i := ids.get(joined := part[a] + part[b])) is not None:
                heapq.heappush(queue, (-scores[i], a, b, len(joined), joined))

        for a in range(len(s) - 1):
            offer(a, a + 1)
        while queue:
            _, a, b, n, joined = heapq.heappop(queue)
            if not part[a] or not part[b] or len(part[a]) + len(part[b]) != n:
                continue  # one of the two has been merged since
            part[a], part[b] = joined, ""
            after[a] = after[b]
            if after[a] >= 0:
                before[after[a]] = a
            offer(before[a], a)
            offer(a, after[a])
        return [p for p in part if p]

    def ids_of(self, pieces: Iterable[str]) -> list[int]:
        out: list[int] = []
        for p in pieces:
            i = self.ids.get(p)
            out += [i] if i is not None else [self.byte_ids[x] for x in p.encode()]
        return out

    def stands(self, a: str, b: str) -> bool:
        """Whether merging the text of two pieces gives these two pieces (or, with b empty, a piece itself).

        Pieces in a row are what merging their text gives if and only if this holds for each two neighbours: the
        first merge across an edge would come as early in the text of those two alone.
        """
        known = self.pairs.get((a, b))
        if known is None:
            if len(self.pairs) > WORD_CACHE:
                self.pairs.clear()
            known = self.pairs[a, b] = self.merged(a + b) == ([a, b] if b else [a])
        return known

    @cached_property
    def _pairs(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Sorted keys (left id << 32 | right id), and the piece and score of each pair that forms a piece."""
        ids, found = self.ids, {}
        for piece, i in ids.items():
            for k in range(1, len(piece)):
                a, b = ids.get(piece[:k]), ids.get(piece[k:])
                if a is not None and b is not None:
                    found[a << 32 | b] = i
        keys = np.fromiter(found, np.int64, len(found))
        order = np.argsort(keys)
        piece = np.fromiter(found.values(), np.int64, len(found))[order]
        return keys[order], piece, np.array(self.scores)[piece]

    @cached_property
    def _characters(self) -> np.ndarray:
        """Id of each character, or -1."""
        out = np.full(0x110000, -1, np.int32)
        for piece, i in self.ids.items():
            if len(piece) == 1:
                out[ord(piece)] = i
        return out

    def _joined(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(piece, score) of neighbours; the score is -inf if they form none."""
        keys, piece, score = self._pairs
        if not len(keys):
            return np.full(left.shape, -1), np.full(left.shape, -np.inf)
        key = left << 32 | right
        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        hit = (keys[k] == key) & (left >= 0) & (right >= 0)
        return piece[k], np.where(hit, score[k], -np.inf)

    def _learn(self, words: list[str]) -> None:
        """Merges words of about one length side by side, a merge of each at a time. Long words and those with
        unknown characters go one by one."""
        lone = [w for w in words if len(w) > SIDE_BY_SIDE]
        groups: dict[int, list[str]] = {}
        for w in words:
            if len(w) <= SIDE_BY_SIDE:
                groups.setdefault(max(4, 1 << (len(w) - 1).bit_length()) if len(w) > 8 else len(w), []).append(w)
        for width, group in groups.items():
            size = np.array([len(w) for w in group])
            code = self._characters[np.frombuffer("".join(group).encode("utf-32-le"), "<u4")].astype(np.int64)
            row = np.repeat(np.arange(len(group)), size)
            ids = np.full((len(group), width + 1), -1, np.int64)
            ids[row, np.arange(len(code)) - np.repeat(np.cumsum(size) - size, size)] = code
            unknown = np.zeros(len(group), bool)
            unknown[row[code < 0]] = True
            lone += [group[i] for i in np.flatnonzero(unknown)]
            at = np.flatnonzero(~unknown)
            ids = ids[at]
            piece, score = self._joined(ids[:, :-1], ids[:, 1:])
            place = np.arange(width + 1)
            while len(at):
                best = score.argmax(1)  # the first among equals
                go = score[np.arange(len(at)), best] > -np.inf
                if not go.all():
                    done = ids[~go]
                    rows = done[done >= 0].tolist()
                    end = np.cumsum((done >= 0).sum(1)).tolist()
                    self.known.update((group[i], tuple(rows[a:b])) for i, a, b in zip(at[~go].tolist(), [0, *end], end))
                    at, ids, piece, score, best = at[go], ids[go], piece[go], score[go], best[go]
                    if not len(at):
                        break
                every = np.arange(len(at))
                merged = piece[every, best]
                # everything right of the pair moves one place to the left
                source = np.minimum(place + (place > best[:, None]), width)
                ids = np.take_along_axis(ids, source, 1)
                ids[every, best], ids[:, -1] = merged, -1
                piece, score = np.take_along_axis(piece, source[:, :-1].clip(max=width - 1), 1), np.take_along_axis(score, source[:, :-1].clip(max=width - 1), 1)
                score[:, -1] = -np.inf
                for to in (best - 1, best):
                    use = np.flatnonzero((to >= 0) & (to < width))
                    to = to[use]
                    piece[use, to], score[use, to] = self._joined(ids[use, to], ids[use, to + 1])
        self.known.update((w, tuple(self.ids_of(self.merged(w)))) for w in lone)

    def encode_many(self, normal: list[str]) -> list[list[int]]:
        """Ids of normalised texts. Words are segmented once and remembered; new ones all at the same time."""
        split = [self.words.findall(s) for s in normal]
        if len(self.known) > WORD_CACHE:
            self.known.clear()
        known = self.known
        self._learn([w for w in set().union(*split) if w not in known])
        out = []
        for words in split:
            ids: list[int] = []
            for w in words:
                ids += known[w]
            out.append(ids)
        return out

    def encode(self, normal: str) -> list[int]:
        return self.encode_many([normal])[0]

    def decode(self, ids) -> str:
        """Text of ids, without the dummy space."""
        raw = b"".join(map(self.pieces.__getitem__, ids))
        return (raw[1:] if raw[:1] == b" " else raw).decode("utf-8", errors="replace")

    def normal(self, text: str) -> str:
        return MARK + text.replace(" ", MARK) if text else ""


_models: dict[str, Model] = {}


def model(path: str) -> Model:
    if path not in _models:
        _models[path] = Model(path)
    return _models[path]
