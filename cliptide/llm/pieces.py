"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie of pieces.

White space is marked, so pieces begin words: where no piece holds a marker after another
character, the best segmentation of a text is that of its words, one after the other. Each task
segments the distinct words of a slice together, position by position in numpy, and keeps a bounded
memory of words it has seen.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from itertools import repeat

import numpy as np
from pyspark.sql import DataFrame

from cliptide.llm.common import Sent, append_struct, free_name

MARK = "▁".encode()
#: A character that no piece covers scores this much less than the worst piece.
UNKNOWN_PENALTY = 10.0
SEEN_WORDS = 500_000
LONG_WORD = 256
CELLS = 1 << 20
#: Bytes of a slice: a word is an object of its own and a piece several numbers of 64 bits while a slice is worked on.
SLICE = 1 << 20

_WORDS = re.compile(rb" *[^ ]+| +")


class DoubleArray:
    """A trie of byte strings: child ``t`` of ``s`` by byte ``c`` is ``base[s] + c`` if ``check[t] == s``."""

    def __init__(self, entries: list[tuple[bytes, int]]):
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for key, value in entries:
            node = 0
            for c in key:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                    values.append(-1)
                node = nxt
            values[node] = value
        size = 2 * len(children) + 1024
        used = bytearray(size)
        used[0] = 1
        base, check, value = [0] * size, [-1] * size, [-1] * size
        place, first, queue = {0: 0}, 1, [0]
        for node in queue:
            if not (below := children[node]):
                continue
            labels = sorted(below)
            while used[first]:
                first += 1
            slot, tries = first, 0
            while True:
                at = slot - labels[0]
                if at + 256 >= len(used):
                    grow = len(used)
                    used.extend(bytes(grow))
                    base += [0] * grow
                    check += [-1] * grow
                    value += [-1] * grow
                if at > 0 and not any(used[at + c] for c in labels):
                    break
                slot += 1
                while slot < len(used) and used[slot]:
                    slot += 1
                tries += 1
            if tries > 64:
                first += (slot - first) // 2
            here = place[node]
            base[here] = at
            for c in labels:
                child, t = below[c], at + c
                used[t], check[t], value[t], place[child] = 1, here, values[child], t
                queue.append(child)
        end = max(place.values()) + 257
        pad = max(0, end - len(base))
        self.base = np.array((base + [0] * pad)[:end], np.int32)
        self.check = np.array((check + [-1] * pad)[:end], np.int32)
        self.value = np.array((value + [-1] * pad)[:end], np.int32)


@dataclass
class PieceModel:
    """Pieces (marker written as a space), their log scores, and the trie over the plain ones."""

    pieces: list[bytes]
    scores: np.ndarray
    byte_ids: np.ndarray
    trie: DoubleArray
    unknown_score: float
    longest: int
    split_words: bool
    #: Bytes each id stands for in a decoded text; control pieces stand for none.
    spelled: list[bytes]


def load(path: str) -> PieceModel:
    """Read a SentencePiece model file (with byte fallback) on the driver."""
    from sentencepiece import SentencePieceProcessor

    reader = SentencePieceProcessor(model_file=path)
    pieces, entries, spelled, split = [], [], [], True
    byte_ids = np.full(256, reader.unk_id(), np.int32)
    scores = np.zeros(reader.get_piece_size())
    for i in range(reader.get_piece_size()):
        piece = reader.id_to_piece(i).encode().replace(MARK, b" ")
        pieces.append(piece)
        scores[i] = reader.get_score(i)
        if reader.is_byte(i):
            byte = int(piece[3:5], 16)
            byte_ids[byte] = i
            spelled.append(bytes([byte]))
        elif reader.is_control(i) or reader.is_unknown(i) or reader.is_unused(i):
            spelled.append(b"")
        else:
            entries.append((piece, i))
            spelled.append(piece)
            split = split and b" " not in piece.lstrip(b" ")
    low = min(scores[i] for _, i in entries)
    return PieceModel(
        pieces, scores, byte_ids, DoubleArray(entries), low - UNKNOWN_PENALTY, max(len(p) for p, _ in entries), split, spelled
    )


def marked(text: bytes) -> bytes:
    """The text as pieces see it: one marker before it, markers for spaces (here: spaces)."""
    return b" " + text.replace(MARK, b" ") if text else b""


def segment(model: PieceModel, word: bytes) -> list[int]:
    """The best-scoring pieces of one string; ties go to the piece that starts first."""
    trie, scores = model.trie, model.scores
    base, check, value = trie.base.item, trie.check.item, trie.value.item
    n = len(word)
    best, back, ids = [float("-inf")] * (n + 1), [0] * (n + 1), [-1] * (n + 1)
    best[0] = 0.0
    for i in range(n):
        if word[i] & 0xC0 == 0x80 and best[i] == float("-inf"):
            continue
        width = min(char_bytes(word[i]), n - i)
        state, single = 0, False
        for j in range(i, n):
            nxt = base(state) + word[j]
            if check(nxt) != state:
                break
            state = nxt
            piece = value(state)
            if piece >= 0:
                single = single or j + 1 - i == width
                total = best[i] + scores[piece]
                if total > best[j + 1]:
                    best[j + 1], back[j + 1], ids[j + 1] = total, i, piece
        if not single:
            total = best[i] + model.unknown_score
            for k in range(i + 1, i + width):
                back[k], ids[k] = k - 1, model.byte_ids[word[k - 1]]
            if total > best[i + width]:
                best[i + width], back[i + width], ids[i + width] = total, i + width - 1, model.byte_ids[word[i + width - 1]]
    result = []
    while n:
        result.append(int(ids[n]))
        n = back[n]
    return result[::-1]


def char_bytes(lead: int) -> int:
    return 1 if lead < 0xC0 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4


_WIDTH = np.array([char_bytes(c) for c in range(256)], np.int64)


def segment_many(model: PieceModel, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The ids of all words, one after the other, and how many each has: ``segment`` in lockstep."""
    base, check, value, scores = model.trie.base, model.trie.check, model.trie.value, model.scores
    n, sizes = len(words), np.array([len(w) for w in words])
    width = int(sizes.max())
    cells = np.frombuffer(b"".join(w.ljust(width, b"\0") for w in words), np.uint8).reshape(n, width)
    best = np.full((n, width + 1), -np.inf)
    best[:, 0] = 0
    back = np.zeros((n, width + 1), np.int32)
    ids = np.full((n, width + 1), -1, np.int32)

    best_at, back_at, ids_at = best.reshape(-1), back.reshape(-1), ids.reshape(-1)

    def offer(rows, ends, totals, starts, pieces):
        at = rows * (width + 1) + ends
        better = np.flatnonzero(totals > best_at[at])
        at = at[better]
        best_at[at], ids_at[at] = totals[better], pieces[better]
        back_at[at] = starts if np.isscalar(starts) else starts[better]

    for i in range(width):
        active = np.flatnonzero((sizes > i) & (((cells[:, i] & 0xC0) != 0x80) | (best[:, i] > -np.inf)))
        wide = np.minimum(_WIDTH[cells[active, i]], sizes[active] - i)
        single = np.zeros(n, bool)
        need = np.zeros(n, np.int64)
        need[active] = wide
        rows, state = active, np.zeros(len(active), np.int32)
        for j in range(i, min(width, i + model.longest)):
            nxt = base[state] + cells[rows, j]
            found = (check[nxt] == state) & (sizes[rows] > j)
            rows, state = rows[found], nxt[found]
            if not len(rows):
                break
            piece = value[state]
            ends = piece >= 0
            if ends.any():
                at, chosen = rows[ends], piece[ends]
                single[at[need[at] == j + 1 - i]] = True
                offer(at, j + 1, best[at, i] + scores[chosen], i, chosen)
        rest = ~single[active]
        if rest.any():
            rows, wide = active[rest], wide[rest]
            for k in range(1, int(wide.max())):
                inner = rows[wide > k]
                back[inner, i + k], ids[inner, i + k] = i + k - 1, model.byte_ids[cells[inner, i + k - 1]]
            last = i + wide
            offer(rows, last, best[rows, i] + model.unknown_score, last - 1, model.byte_ids[cells[rows, last - 1]])
    at, rows, steps = sizes.copy(), np.arange(n), []
    while len(rows):
        here = at[rows]
        steps.append((rows, ids[rows, here]))
        at[rows] = back[rows, here]
        rows = rows[at[rows] > 0]
    counts = np.bincount(np.concatenate([r for r, _ in steps]), minlength=n)
    flat = np.empty(int(counts.sum()), np.int32)
    ends = np.cumsum(counts)
    for k, (rows, found) in enumerate(steps):
        flat[ends[rows] - 1 - k] = found
    return flat, counts


class Encoder:
    """Encodes texts; remembers the pieces of at most about ``SEEN_WORDS`` words."""

    def __init__(self, model: PieceModel):
        self.model = model
        self._forget()

    def _forget(self):
        self.seen: dict[bytes, int] = {}
        self.ids = np.empty(0, np.int32)
        self.starts = np.zeros(1, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        flat, counts = [self.ids], [np.diff(self.starts)]
        words = sorted(words, key=len)
        brief = [w for w in words if len(w) <= LONG_WORD]
        at = 0
        while at < len(brief):
            n = max(1, CELLS // 4 // len(brief[min(len(brief) - 1, at + 4096)]))
            some, sizes = segment_many(self.model, brief[at : at + min(n, 4096)])
            flat.append(some)
            counts.append(sizes)
            at += min(n, 4096)
        for word in words[len(brief) :]:
            some = segment(self.model, word)
            flat.append(np.array(some, np.int32))
            counts.append(np.array([len(some)]))
        for word in words:
            self.seen[word] = len(self.seen)
        self.ids = np.concatenate(flat)
        self.starts = np.concatenate([[0], np.cumsum(np.concatenate(counts))])

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after the other, and the bounds of each text's."""
        split = _WORDS.findall if self.model.split_words else lambda t: [t] if t else []
        words, per_text = [], [0]
        for text in texts:
            words += split(marked(text or b""))
            per_text.append(len(words))
        if len(self.seen) > SEEN_WORDS:
            self._forget()
        find = self.seen.get
        index = np.fromiter(map(find, words, repeat(-1)), np.int64, len(words))
        new = np.flatnonzero(index < 0)
        if len(new):
            unknown = [words[i] for i in new.tolist()]
            self._learn(list(set(unknown)))
            index[new] = np.fromiter(map(find, unknown), np.int64, len(unknown))
        flat, bounds = gathered(self.ids, self.starts, index)
        return flat, bounds[per_text]


def gathered(values: np.ndarray, starts: np.ndarray, index: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Concatenate the runs ``values[starts[i]:starts[i + 1]]`` for i in ``index``; also their bounds."""
    sizes = starts[index + 1] - starts[index]
    bounds = np.concatenate([[0], np.cumsum(sizes)])
    at = np.arange(bounds[-1]) + np.repeat(starts[index] - bounds[:-1], sizes)
    return values[at], bounds


def encode(docs: DataFrame, model: PieceModel, text: str = "text", out: str = "pieces") -> DataFrame:
    """``docs`` with a struct ``out`` of (ids, n_bytes): piece ids, and how many stand for a byte.

    A null or empty text has no pieces. Whole texts are encoded, however long; a single word of
    more than ``LONG_WORD`` bytes is segmented by itself. Repeated rows are encoded each; an empty
    table gives an empty table. Columns of any name are carried through; should ``out`` be taken,
    underscores are added to it.
    """
    sent = Sent(docs.sparkSession, model)
    memory: dict[str, Encoder] = {}

    def make(values):
        import pyarrow as pa

        if "encoder" not in memory:
            memory["encoder"] = Encoder(sent.value)
        ids, bounds = memory["encoder"].encode(values)
        byte = np.concatenate([[0], np.cumsum(np.isin(ids, sent.value.byte_ids))])
        lists = pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))
        return lists, byte[bounds[1:]] - byte[bounds[:-1]]

    return append_struct(docs, text, free_name(docs, out), "ids array<int>, n_bytes long", make, limit=SLICE)


def spell(model: PieceModel, ids: np.ndarray, bounds: np.ndarray) -> list[str]:
    """Texts for runs of ids: byte pieces are joined to characters, markers become spaces."""
    table = np.frombuffer(b"".join(model.spelled), np.uint8)
    starts = np.concatenate([[0], np.cumsum([len(s) for s in model.spelled])])
    flat, per_piece = gathered(table, starts, ids.astype(np.int64))
    whole, cuts = flat.tobytes(), per_piece[bounds]
    texts = []
    for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        part = whole[a:b]
        texts.append((part[1:] if part[:1] == b" " else part).decode("utf-8", "replace"))
    return texts


def decode(encoded: DataFrame, model: PieceModel, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encoded`` with a struct ``out`` of (text): the text its list of piece ids spells.

    Control pieces spell nothing; byte pieces that make no character become U+FFFD. A null or
    empty list gives an empty text. A marker character in the original text comes back as a space.
    Ids outside the model fail. Columns of any name are carried through; should ``out`` be taken,
    underscores are added to it.
    """
    sent = Sent(encoded.sparkSession, model)

    def read(column):
        sizes = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
        return column.flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(sizes)])

    return append_struct(
        encoded, ids, free_name(encoded, out), "text string", lambda v: (spell(sent.value, v[0], v[1].astype(np.int64)),), read, SLICE
    )
