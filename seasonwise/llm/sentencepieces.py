"""Subword encoding and decoding with a scored piece vocabulary.

A text is cut into the pieces with the largest sum of scores (Viterbi) over a double-array
trie of the pieces' UTF-8 bytes. White space becomes a marker that starts a word, so no piece
crosses words and each distinct word is cut once per task. Characters without a piece become
byte pieces.
"""

import re
import zlib
from collections.abc import Iterator
from operator import itemgetter

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from seasonwise.llm.common import map_rows, tokenizer_path

MARK = "▁"
WORDS = re.compile(" *[^ ]+| +")
# How far an unknown character ranks below the worst piece.
UNKNOWN_PENALTY = 10.0
# Characters of texts whose new words are cut together, and words and cells of one table.
CHARS_TOGETHER = 4_000_000
CUT_TOGETHER = 100_000
MOST_CELLS = 2_000_000
# Bytes of a character by its first byte.
CHAR_BYTES = np.array([1] * 0x80 + [2] * 0x60 + [3] * 0x10 + [4] * 0x10)


class DoubleArray:
    """Trie in two flat arrays: ``check[base[s] + byte] == s`` if the step exists.

    A string ends at state s if ``check[base[s]] == s`` (byte 0 ends strings), and then
    ``base[base[s]]`` is ``-1 - value``.
    """

    def __init__(self, entries: dict[bytes, int]):
        keys = sorted(entries)
        base, check = [0] * 1024, [-1] * 1024
        free = 1
        check[0] = 0
        todo = [(0, 0, len(keys), 0)]
        while todo:
            state, low, high, depth = todo.pop()
            children, k = [], low
            if len(keys[k]) == depth:
                children.append((0, k, k + 1))
                k += 1
            while k < high:
                byte, first = keys[k][depth], k
                while k < high and keys[k][depth] == byte:
                    k += 1
                children.append((byte, first, k))
            while check[free] != -1:
                free += 1
                if free + 512 > len(check):
                    base += [0] * len(base)
                    check += [-1] * len(check)
            start = free - children[0][0]
            while start < 1 or any(check[start + c] != -1 for c, _, _ in children):
                start += 1
                if start + 512 > len(check):
                    base += [0] * len(base)
                    check += [-1] * len(check)
            base[state] = start
            for byte, first, end in children:
                check[start + byte] = state
                if byte == 0:
                    base[start] = -1 - entries[keys[first]]
                else:
                    todo.append((start + byte, first, end, depth + 1))
        used = max(k for k, c in enumerate(check) if c != -1) + 257
        self.base = np.array((base + [0] * 512)[:used], dtype=np.int32)
        self.check = np.array((check + [-1] * 512)[:used], dtype=np.int32)


class Pieces:
    """Vocabulary of a SentencePiece model file, read through its library."""

    def __init__(self, file: str):
        import sentencepiece
        model = sentencepiece.SentencePieceProcessor(model_file=tokenizer_path(file))
        names = [model.id_to_piece(i) for i in range(len(model))]
        self.byte_ids = [0] * 256
        self.surface: list[bytes] = []
        self.scores: dict[int, float] = {}
        entries = {}
        for i, name in enumerate(names):
            if model.is_byte(i):
                value = int(name[3:5], 16)
                self.byte_ids[value] = i
                self.surface.append(bytes([value]))
            elif model.is_control(i) or model.is_unknown(i) or model.is_unused(i):
                self.surface.append(b"")
            else:
                if MARK in name.lstrip(MARK):
                    raise ValueError(f"piece {name!r} crosses words")
                self.surface.append(name.replace(MARK, " ").encode())
                self.scores[i] = model.get_score(i)
                entries[name.encode()] = i
        self.unknown = min(self.scores.values()) - UNKNOWN_PENALTY
        self.trie = DoubleArray(entries)


class Codec:
    """Encoder and decoder of one task; ``max_words`` bounds its memory.

    Words that are new are cut together: the search runs over positions, and at each position
    over all words at once in flat arrays.
    """

    def __init__(self, pieces: Pieces, max_words: int = 300_000):
        self.pieces, self.max_words = pieces, max_words
        self.base, self.check = pieces.trie.base, pieces.trie.check
        self.score_of = np.zeros(len(pieces.surface))
        self.score_of[list(pieces.scores)] = list(pieces.scores.values())
        # An unknown character counts once, with the first of its bytes.
        self.byte_ids = np.array(pieces.byte_ids)
        self.score_of[[i for b, i in enumerate(pieces.byte_ids) if b & 0xC0 != 0x80]] = \
            pieces.unknown
        self.known: dict[str, bytes] = {}

    def best_path(self, word: str) -> tuple[list[int], float]:
        """Pieces with the largest sum of scores; among equals the longer last piece."""
        ids = np.frombuffer(self._cut([word])[0], "<u4")
        return ids.tolist(), float(self.score_of[ids].sum())

    def _learn(self, words: set[str]) -> None:
        new = [w for w in words if w not in self.known]
        if len(self.known) + len(new) > self.max_words:
            self.known.clear()
            new = list(words)
        new.sort(key=len)
        for first in range(0, len(new), CUT_TOGETHER):
            part = new[first:first + CUT_TOGETHER]
            self.known.update(zip(part, self._cut(part)))

    def _cut(self, words: list[str]) -> list[bytes]:
        """Ids of the best path of each word, as unsigned little-endian 32-bit numbers."""
        data = [w.encode("utf-8", "replace") for w in words]
        found, first = [], 0
        while first < len(data):
            # Words of like length share a table of positions.
            last, width = first + 1, max(len(data[first]), 1)
            while last < len(data) and (last - first) * width < MOST_CELLS \
                    and len(data[last]) <= 2 * len(data[first]) + 4:
                width = max(width, len(data[last]))
                last += 1
            found += self._cut_table(data[first:last], width)
            first = last
        return found

    def _cut_table(self, data: list[bytes], width: int) -> list[bytes]:
        n, base, check = len(data), self.base, self.check
        sizes = np.array([len(d) for d in data])
        owner = np.repeat(np.arange(n), sizes)
        place = np.arange(len(owner)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        letters = np.zeros((width + 4, n), np.uint8)
        letters[place, owner] = np.frombuffer(b"".join(data), np.uint8)
        best = np.full((width + 4, n), -np.inf)
        came = np.zeros((width + 4, n), np.int32)
        piece = np.full((width + 4, n), -1, np.int32)
        best[0] = 0.0

        def offer(end, lanes, score, start, ids):
            better = score > best[end, lanes]
            lanes = lanes[better]
            best[end, lanes], came[end, lanes] = score[better], start
            piece[end, lanes] = ids[better] if ids is not None else -1

        single = np.zeros(n, bool)
        for start in range(width):
            lanes = np.flatnonzero((best[start] > -np.inf) & (sizes > start))
            if not len(lanes):
                continue
            single[lanes] = False
            span = CHAR_BYTES[letters[start, lanes]]
            live, state = lanes, np.zeros(len(lanes), np.int32)
            so_far, wide = best[start, lanes], span
            for at in range(start, width):
                byte = letters[at, live]
                step = base[state] + byte
                ok = (check[step] == state) & (byte != 0)
                live, state, so_far, wide = live[ok], step[ok], so_far[ok], wide[ok]
                if not len(live):
                    break
                leaf = base[state]
                hit = np.flatnonzero(check[leaf] == state)
                if len(hit):
                    ids = -1 - base[leaf[hit]]
                    offer(at + 1, live[hit], so_far[hit] + self.score_of[ids], start, ids)
                    single[live[hit[wide[hit] == at + 1 - start]]] = True
            missed = ~single[lanes]
            for size in np.unique(span[missed]):
                some = lanes[missed & (span == size)]
                offer(start + int(size), some, best[start, some] + self.pieces.unknown, start, None)
        return self._trace(letters, sizes, came, piece)

    def _trace(self, letters, sizes, came, piece) -> list[bytes]:
        """Paths from their ends to their beginnings, then turned round."""
        lanes, end = np.flatnonzero(sizes > 0), sizes[sizes > 0]
        owners, places, ids = [], [], []
        while len(lanes):
            start, found = came[end, lanes], piece[end, lanes]
            known = found >= 0
            owners.append(lanes[known])
            places.append(start[known])
            ids.append(found[known])
            some = np.flatnonzero(~known)
            for k in range(int((end[some] - start[some]).max()) if len(some) else 0):
                some = some[start[some] + k < end[some]]
                at = start[some] + k
                owners.append(lanes[some])
                places.append(at)
                ids.append(self.byte_ids[letters[at, lanes[some]]])
            lanes, end = lanes[start > 0], start[start > 0]
        if not owners:
            return [b""] * len(sizes)
        owner, place = np.concatenate(owners), np.concatenate(places)
        order = np.lexsort((place, owner))
        flat = np.concatenate(ids)[order].astype("<u4").tobytes()
        ends = np.cumsum(np.bincount(owner, minlength=len(sizes))) * 4
        return [flat[a:b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]

    def encode_all(self, texts: list[str]) -> Iterator[bytes]:
        """Ids of each text (unsigned little-endian 32-bit numbers)."""
        first = 0
        while first < len(texts):
            split, size, last = [], 0, first
            while last < len(texts) and size < CHARS_TOGETHER:
                split.append(_units(texts[last]))
                size, last = size + len(texts[last]), last + 1
            self._learn(set().union(*split))
            for units in split:
                yield b"".join(map(self.known.__getitem__, units))
            first = last

    def encode(self, text: str) -> tuple[bytes, float]:
        """Ids of one text and their summed score."""
        data, = self.encode_all([text])
        return data, self.score(np.frombuffer(data, "<u4"))

    def score(self, ids: np.ndarray) -> float:
        return float(self.score_of[ids].sum())

    def surface(self, ids: list[int]) -> bytes:
        """Bytes of ids; the marker that was put in front is taken away."""
        data = (b"".join(itemgetter(*ids)(self.pieces.surface)) if len(ids) > 1 else
                self.pieces.surface[ids[0]] if ids else b"")
        return data[1:] if data[:1] == b" " else data

    def decode(self, ids) -> str:
        """Text of ids."""
        return self.surface(list(ids)).decode("utf-8", "replace")


def _units(text: str) -> list[str]:
    """Words of a text with the marker for the white space before them; joined, the whole text."""
    if not text:
        return []
    if MARK in text:
        text = text.replace(MARK, " ")
    if "  " not in text and text[0] != " " and text[-1] != " ":
        return (MARK + text.replace(" ", " " + MARK)).split(" ")
    return [part.replace(" ", MARK) for part in WORDS.findall(" " + text)]


def _shared(df: DataFrame, file: str):
    # The size of the vocabulary bounds this broadcast (some megabytes).
    return df.sparkSession.sparkContext.broadcast(Pieces(file))


def encode(docs: DataFrame, file: str = "piece_bpe_32k.model", doc_id: str = "doc_id",
           text: str = "text") -> DataFrame:
    """``doc_id, ids array<int>, score``: pieces of every whole text.

    Null and empty texts have no pieces and score 0; repeated rows each get a row; other columns
    are not looked at.
    """
    shared = _shared(docs, file)

    def run(batches):
        codec = Codec(shared.value)
        for keys, texts in batches:
            for key, data in zip(keys, codec.encode_all([value or "" for value in texts])):
                ids = np.frombuffer(data, dtype="<u4")
                yield key, ids.astype(np.int32), codec.score(ids)

    return map_rows(_chosen(docs, doc_id, text), run, "doc_id long, ids array<int>, score double",
                    batch_rows=256)


def decode(encoded: DataFrame, file: str = "piece_bpe_32k.model", doc_id: str = "doc_id",
           ids: str = "ids") -> DataFrame:
    """``doc_id, text`` of arrays of ids; a null array gives a null text."""
    shared = _shared(encoded, file)

    def run(batches):
        codec = Codec(shared.value)
        for keys, arrays in batches:
            for key, value in zip(keys, arrays):
                yield key, None if value is None else codec.decode(value)

    return map_rows(encoded.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                                   F.col(f"`{ids}`").alias("ids")), run,
                    "doc_id long, text string", batch_rows=256)


def digests(docs: DataFrame, file: str = "piece_bpe_32k.model", doc_id: str = "doc_id",
            text: str = "text") -> DataFrame:
    """Encoding and decoding of every whole text in one pass, without keeping the ids.

    ``doc_id, n_pieces, ids_crc32`` (of unsigned little-endian 32-bit ids), ``score, n_bytes``
    (pieces that stand for one byte), ``text_crc32`` (of the decoded text in UTF-8) and
    ``round_trip`` (the decoded text equals the given one; a marker sign in a text reads as a
    space). Rows as in ``encode``.
    """
    shared = _shared(docs, file)

    def run(batches):
        pieces = shared.value
        codec = Codec(pieces)
        single = np.zeros(len(pieces.surface), dtype=bool)
        single[pieces.byte_ids] = True
        for keys, texts in batches:
            texts = [value or "" for value in texts]
            for key, value, data in zip(keys, texts, codec.encode_all(texts)):
                ids = np.frombuffer(data, dtype="<u4")
                back = codec.surface(ids.tolist())
                same = back == value.encode("utf-8", "replace")
                if not same:  # pieces need not join to valid UTF-8
                    back = back.decode("utf-8", "replace").encode()
                yield (key, len(ids), zlib.crc32(data), codec.score(ids), int(single[ids].sum()),
                       zlib.crc32(back), same)

    return map_rows(_chosen(docs, doc_id, text), run,
                    "doc_id long, n_pieces long, ids_crc32 long, score double, n_bytes long, "
                    "text_crc32 long, round_trip boolean")


def _chosen(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"),
                       F.col(f"`{text}`").alias("text"))
