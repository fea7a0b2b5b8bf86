"""Byte-pair encoding as a transducer that is determinised as it is used.

The encoding of a prefix is the encoding of a shorter prefix plus one token.  So one token per position
says it all, and which one follows from the tokens a few bytes back: a finite-state machine whose states
are found, numbered and kept as the text reaches them.
"""

from __future__ import annotations

import base64
import codecs
from itertools import chain

import numpy as np

from wayfold.llm.pieces import parts_of, pieces_of

#: Most pair decisions and most pieces kept by one process; beyond that the tables begin anew.  Moves are
#: bounded by the vocabulary: each of its prefixes has at most 256.
MOST_PAIRS = 600_000
MOST_PIECES = 300_000
#: Characters of texts that are cut into pieces at a time.
BATCH = 1 << 19
#: Bytes of a long piece between two flushes of what is certain.
FLUSH = 256
NEVER = 1 << 40


def read_ranks(data: bytes) -> dict[bytes, int]:
    """The tokens of a rank file: base64 bytes and id in each line."""
    return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in data.splitlines() if line)}


class Merges:
    """What the merge list says about tokens and pairs of them.  Ids are merge ranks; single bytes come first."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.pair: dict[tuple[int, int], int] = {}
        halves: dict[int, tuple[int, int]] = {}
        for token, rank in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                parts = self._merged(token, rank)
                if len(parts) == 2:
                    halves[rank] = (parts[0], parts[1])
                    self.pair[parts[0], parts[1]] = rank
        #: For each token the blocks at its right and left edge: (block, rank of the merge that ends it).
        self.right = {t: self._edge(t, halves, 1) for t in self.bytes_of}
        self.left = {t: self._edge(t, halves, 0) for t in self.bytes_of}
        self.after: dict[int, dict[int, int]] = {}
        for (x, y), rank in self.pair.items():
            self.after.setdefault(x, {})[y] = rank
        self.known_apart: dict[int, bool] = {}

    def _merged(self, token: bytes, below: int) -> list[int]:
        """The token's blocks once all merges ranked under ``below`` are made."""
        parts = [self.ranks[token[i : i + 1]] for i in range(len(token))]
        while len(parts) > 1:
            rank, at = min((self.pair.get((parts[i], parts[i + 1]), NEVER), i) for i in range(len(parts) - 1))
            if rank >= below:
                break
            parts[at : at + 2] = [rank]
        return parts

    def _edge(self, token: int, halves: dict, side: int) -> list[tuple[int, int]]:
        out, ended = [], NEVER
        while True:
            out.append((token, ended))
            if token not in halves:
                return out
            ended, token = token, halves[token][side]

    def apart(self, a: int, b: int) -> bool:
        """Whether two tokens side by side stay two: no merge across their border comes before both are whole."""
        if len(self.known_apart) > MOST_PAIRS:
            self.known_apart.clear()
        known = self.known_apart[a << 24 | b] = self._stay_apart(a, b)
        return known

    def _stay_apart(self, a: int, b: int) -> bool:
        left = self.left[b]
        for x, x_ends in self.right[a]:
            merges = self.after.get(x)
            if merges is not None:
                for y, y_ends in left:
                    m = merges.get(y, NEVER)
                    if m < x_ends and m != NEVER and m <= y_ends:
                        return False
        return True


class Transducer:
    """Encodes bytes; its states and moves are made when first needed."""

    def __init__(self, ranks: dict[bytes, int]):
        self.merges = Merges(ranks)
        self.length = {rank: len(token) for token, rank in ranks.items()}
        self._build_suffixes(ranks)
        self.pieces = _Pieces(self)

    def _build_suffixes(self, ranks: dict[bytes, int]) -> None:
        """The machine that knows, after any bytes, their longest end that begins a token."""
        children: list[dict[int, int]] = [{}]
        depth, token_at = [0], [-1]
        for token, rank in ranks.items():
            node = 0
            for byte in token:
                nxt = children[node].get(byte)
                if nxt is None:
                    nxt = children[node][byte] = len(children)
                    children.append({})
                    depth.append(depth[node] + 1)
                    token_at.append(-1)
                node = nxt
            token_at[node] = rank
        fall = [0] * len(children)
        queue = list(children[0].values())
        for node in queue:
            for byte, child in children[node].items():
                queue.append(child)
                back = fall[node]
                while back and byte not in children[back]:
                    back = fall[back]
                fall[child] = children[back].get(byte, 0)
        self.children, self.depth, self.token_at, self.fall = children, depth, token_at, fall
        self.moves: dict[int, int] = {}
        self.ending: list[list[tuple[int, int]] | None] = [None] * len(children)

    def _move(self, key: int) -> int:
        """Makes the move of ``node << 8 | byte``: to the longest end of the bytes read that begins a token."""
        node, byte = key >> 8, key & 255
        while node and byte not in self.children[node]:
            node = self.fall[node]
        self.moves[key] = node = self.children[node].get(byte, 0)
        if self.ending[node] is None:
            found, end = [], node
            while end:
                if self.token_at[end] >= 0:
                    found.append((self.token_at[end], self.depth[end]))
                end = self.fall[end]
            self.ending[node] = found
        return node

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """The ids of one piece.

        ``lasts`` is the machine's register: the token that ends after each byte not yet certain, behind the
        last certain one (-1 where there is none).  Of the tokens that end after a byte, the one that stays
        apart from the token before it is the next.
        """
        whole = self.merges.ranks.get(data)
        if whole is not None:
            return (whole,)
        out: list[int] = []
        lasts = [-1]
        node, move_of, apart_of, ending = 0, self.moves.get, self.merges.known_apart.get, self.ending
        for a in range(0, len(data), FLUSH):
            for byte in data[a : a + FLUSH]:
                key = node << 8 | byte
                node = move_of(key)
                if node is None:
                    node = self._move(key)
                for token, size in ending[node]:
                    last = lasts[-size]
                    if last < 0:
                        break
                    stay = apart_of(last << 24 | token)
                    if stay is None:
                        stay = self.merges.apart(last, token)
                    if stay:
                        break
                lasts.append(token)
            if a + FLUSH < len(data):
                self._flush(lasts, self.depth[node], out)
        out += self._back(lasts, len(lasts) - 1)
        return tuple(out)

    def _back(self, lasts: list[int], at: int) -> list[int]:
        tokens = []
        while at > 0:
            tokens.append(lasts[at])
            at -= self.length[lasts[at]]
        return tokens[::-1]

    def _flush(self, lasts: list[int], reach: int, out: list[int]) -> None:
        """Emits the tokens up to the last border that every continuation shares: a later token begins at
        most ``reach`` bytes back, so the encodings of those prefixes are all that can be continued."""
        paths = []
        for at in range(max(0, len(lasts) - 1 - reach), len(lasts)):
            path = {at}
            while at > 0:
                at -= self.length[lasts[at]]
                path.add(at)
            paths.append(path)
        sure = max(set.intersection(*paths))
        out += self._back(lasts, sure)
        del lasts[:sure]

    def encode_many(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """``lengths, ids``: the number of ids of each text, and all ids one after another.  An empty and a
        null text have none."""
        parts = [parts_of(t) if t else [""] for t in texts]
        flat = list(chain.from_iterable(parts))
        lengths, ids, a = [], [], 0
        while a < len(flat):
            b, chars = a, 0
            while b < len(flat) and (b == a or chars + len(flat[b]) <= BATCH):
                chars += len(flat[b])
                b += 1
            if len(self.pieces) > MOST_PIECES:
                self.pieces.clear_all()
            found, places = pieces_of(flat[a:b])
            numbers = np.fromiter(map(self.pieces.__getitem__, found), dtype=np.int64, count=len(found))
            size, first = self.pieces.size[numbers], self.pieces.first[numbers]
            upto = np.cumsum(size)
            lengths.append(np.diff(upto[places], prepend=0))
            ids.append(self.pieces.ids[np.repeat(first - upto + size, size) + np.arange(upto[-1])])
            a = b
        of_parts = np.concatenate(lengths) if lengths else np.zeros(0, dtype=np.int64)
        first = np.cumsum([0, *map(len, parts)])
        sums = np.concatenate([[0], np.cumsum(of_parts)])
        return np.diff(sums[first]), np.concatenate(ids) if ids else np.zeros(0, dtype=np.int32)

    def encode(self, text: str | None) -> list[int]:
        """The ids of one text."""
        return self.encode_many([text])[1].tolist()


class _Pieces(dict):
    """The number of each piece seen; its ids lie at ``first`` in ``ids``, ``size`` of them."""

    def __init__(self, machine: Transducer):
        self.machine = machine
        self.ids, self.first, self.size = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64), np.zeros(1 << 14, np.int64)
        self.clear_all()

    def clear_all(self) -> None:
        self.clear()
        self.used = 0
        self[""] = 0  # stands after each text and has no ids

    def __missing__(self, piece: str) -> int:
        ids, number = self.machine.encode_bytes(piece.encode()), len(self)
        if number >= len(self.first):
            self.first, self.size = np.resize(self.first, 2 * number), np.resize(self.size, 2 * number)
        while self.used + len(ids) > len(self.ids):
            self.ids = np.resize(self.ids, 2 * len(self.ids))
        self.ids[self.used : self.used + len(ids)] = ids
        self.first[number], self.size[number] = self.used, len(ids)
        self.used += len(ids)
        self[piece] = number
        return number


def decode(bytes_of: dict[int, bytes], ids) -> str:
    """The text of ids: an incremental UTF-8 machine takes the bytes of one token after another, so tokens
    may end inside a character; bytes that are no UTF-8 come out as U+FFFD."""
    machine = codecs.getincrementaldecoder("utf-8")("replace")
    return "".join([machine.decode(bytes_of[i]) for i in ids] + [machine.decode(b"", final=True)])


_MACHINES: dict[int, Transducer] = {}


def machine_for(data: bytes) -> Transducer:
    """One machine per process and rank file: its tables serve all tasks of that process."""
    key = hash(data)
    if key not in _MACHINES:
        _MACHINES[key] = Transducer(read_ranks(data))
    return _MACHINES[key]

