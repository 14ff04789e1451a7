"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie.

The pieces come from a SentencePiece model file and lie in a double-array trie of their UTF-8
bytes, the white space marker as one byte 0x20. A text is encoded by the segmentation of the
highest total log score; a character that no piece starts with is unknown, costs the lowest
score less 10, and becomes its byte pieces. Decoding joins the pieces, turns markers into
spaces and byte pieces into bytes, and drops the marker put before the text.

No piece but runs of markers crosses the start of a marked word, so a text's best segmentation
is that of its words, and a word that recurs (byte for byte) within a group of texts is segmented once. The
words of a group are segmented together, one step of the trie for all words at a time; a word
longer than ``LONG`` bytes is segmented by itself, in time linear in its length.

The public models hold ranks of merges in place of log scores; ``zipf_scores`` gives the piece
of rank r the log score of Zipf's law, -ln(r + 1) less the log of their sum. ``Pieces.load``
does so for a model whose scores are such ranks; log scores of a true unigram model are used
as they are.

Edge cases: a null or empty text has no ids and decodes to an empty text. A marker character
in the input is white space, as in the library. Control pieces are never made and decode to
nothing; ids out of range are an error. Repeated rows are encoded each; an empty table gives
an empty result. Only the named columns are read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import names_of, text_groups

MARKER = "▁"
LONG = 64
GROUP = 4 << 20
STRETCH = 1024
UNKNOWN_PENALTY = 10.0


def zipf_scores(ranks: np.ndarray) -> np.ndarray:
    return -np.log(ranks + 1.0) - np.log((1 / (np.arange(len(ranks)) + 1.0)).sum())


@dataclass
class DoubleArray:
    """Node s has child c iff check[base[s] + c] == s; value[s] is the id of the key that ends there, or -1."""

    base: np.ndarray
    check: np.ndarray
    value: np.ndarray

    @classmethod
    def build(cls, keys: dict[bytes, int]) -> DoubleArray:
        children: list[dict[int, int]] = [{}]
        values = [-1]
        for key, number in keys.items():
            node = 0
            for c in key:
                node_after = children[node].get(c)
                if node_after is None:
                    node_after = children[node][c] = len(children)
                    children.append({})
                    values.append(-1)
                node = node_after
            values[node] = number
        size = 4 * len(children) + 4096
        base, check, value = np.zeros(size, np.int32), np.full(size, -1, np.int32), np.full(size, -1, np.int32)
        free = np.ones(size, bool)
        free[0] = False
        place, low, queue = {0: 0}, 1, [0]
        for node in queue:
            labels, at = sorted(children[node]), place[node]
            value[at] = values[node]
            if not labels:
                continue
            low += int(free[low:].argmax())
            start = max(1, low - labels[0])
            while True:  # the first place where all children's cells are free, a stretch of places at a time
                fits = free[start + labels[0] : start + labels[0] + STRETCH].copy()
                for c in labels[1:]:
                    fits &= free[start + c : start + c + STRETCH]
                if fits.any():
                    start += int(fits.argmax())
                    break
                start += STRETCH
            base[at] = start
            for c in labels:
                free[start + c] = False
                check[start + c] = at
                place[children[node][c]] = start + c
                queue.append(children[node][c])
        return cls(base, check, value)


@dataclass
class Pieces:
    """A vocabulary: the trie, the score of each id, the byte pieces' ids and what each id decodes to."""

    trie: DoubleArray
    score: np.ndarray
    byte_ids: np.ndarray
    text: np.ndarray  # all ids' bytes, joined
    text_at: np.ndarray

    @classmethod
    def build(cls, pieces: list[str], scores: np.ndarray, normal: np.ndarray, byte_of: np.ndarray) -> Pieces:
        """normal: whether an id is an ordinary piece; byte_of: the byte of a byte piece, else -1."""
        raw = [p.replace(MARKER, " ").encode() for p in pieces]
        keys = {r: k for k, r in enumerate(raw) if normal[k] and r}
        if any(b" " in r.lstrip(b" ") for r in keys):
            raise ValueError("a piece holds white space after other characters")
        shown = [bytes([byte_of[k]]) if byte_of[k] >= 0 else raw[k] if normal[k] else b"" for k in range(len(raw))]
        byte_ids = np.full(256, -1, np.int64)
        byte_ids[byte_of[byte_of >= 0]] = np.flatnonzero(byte_of >= 0)
        if (byte_ids < 0).any():
            raise ValueError("the model has no byte fallback")
        return cls(DoubleArray.build(keys), scores.astype(np.float32), byte_ids, np.frombuffer(b"".join(shown), np.uint8), np.cumsum([0, *map(len, shown)]))

    @classmethod
    def load(cls, path: str, zipf: bool | None = None) -> Pieces:
        """zipf: whether scores are ranks; if None, where all are whole numbers."""
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.vocab_size()
        pieces = [model.id_to_piece(i) for i in range(n)]
        byte_of = np.array([int(p[3:5], 16) if model.is_byte(i) else -1 for i, p in enumerate(pieces)])
        normal = np.array([not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i)) for i in range(n)])
        scores = np.array([model.get_score(i) for i in range(n)])
        if zipf is None:
            zipf = np.array_equal(scores[normal], np.round(scores[normal]))
        if zipf:
            ranks = np.zeros(n)
            ranks[normal] = np.arange(normal.sum())
            scores = np.where(normal, zipf_scores(ranks), 0.0)
        return cls.build(pieces, scores, normal, byte_of)

    @property
    def unknown(self) -> np.float32:
        return np.float32(self.score[self.trie.value[self.trie.value >= 0]].min() - UNKNOWN_PENALTY)


#: Bytes of the UTF-8 character that a first byte begins; 0 for the bytes within one.
CHAR_BYTES = np.ones(256, np.int64)
CHAR_BYTES[0x80:0xC0], CHAR_BYTES[0xC0:0xE0], CHAR_BYTES[0xE0:0xF0], CHAR_BYTES[0xF0:] = 0, 2, 3, 4


def segment_words(p: Pieces, words: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Best edges (word, start, end, id or -1 if unknown) of rows words[:, :size], all words together."""
    n, wide = words.shape
    t, unknown = p.trie, p.unknown
    best = np.full((n, wide + 5), -np.inf, np.float32)
    best[:, 0] = 0
    come, piece = np.zeros((n, wide + 5), np.int16), np.full((n, wide + 5), -1, np.int32)
    for s in range(wide):
        row = np.flatnonzero((size > s) & (CHAR_BYTES[words[:, s]] > 0))
        if not len(row):
            continue
        here, chars = best[row, s], CHAR_BYTES[words[row, s]]
        known = np.zeros(len(row), bool)
        live, node = np.arange(len(row)), np.zeros(len(row), np.int64)
        for end in range(s, wide):
            live_in = size[row[live]] > end
            live, node = live[live_in], node[live_in]
            after = t.base[node] + words[row[live], end]
            step = t.check[after] == node
            live, node = live[step], after[step]
            if not len(live):
                break
            got = t.value[node]
            hit = np.flatnonzero(got >= 0)
            if len(hit):
                who, number = live[hit], got[hit]
                known[who] |= chars[who] == end + 1 - s
                total = here[who] + p.score[number]
                better = total > best[row[who], end + 1]
                who, number = who[better], number[better]
                best[row[who], end + 1], come[row[who], end + 1], piece[row[who], end + 1] = total[better], s, number
        odd = np.flatnonzero(~known)
        to = np.minimum(s + chars[odd], size[row[odd]])
        total = here[odd] + unknown
        better = total > best[row[odd], to]
        odd, to = odd[better], to[better]
        best[row[odd], to], come[row[odd], to], piece[row[odd], to] = total[better], s, -1
    edges, row, end = [], np.arange(n), size.copy()
    while len(row):
        row, end = row[end > 0], end[end > 0]
        start = come[row, end].astype(np.int64)
        edges.append((row, start, end, piece[row, end].astype(np.int64)))
        end = start
    word, start, end, number = (np.concatenate(x) for x in zip(*edges)) if edges else (np.empty(0, np.int64),) * 4
    order = np.lexsort((start, word))
    return word[order], start[order], end[order], number[order]


def segment_long(p: Pieces, word: bytes) -> list[tuple[int, int, int]]:
    """segment_words() of one word of any length: (start, end, id or -1)."""
    base, check, value, score = p.trie.base, p.trie.check, p.trie.value, p.score
    n, unknown = len(word), p.unknown
    best = np.full(n + 5, -np.inf, np.float32)
    best[0] = 0
    come, piece = [0] * (n + 5), [-1] * (n + 5)
    for s in range(n):
        width = int(CHAR_BYTES[word[s]])
        if not width:
            continue
        node, known = 0, False
        for end in range(s, n):
            after = base[node] + word[end]
            if check[after] != node:
                break
            node = after
            if value[node] >= 0:
                known |= end + 1 - s == width
                total = best[s] + score[value[node]]
                if total > best[end + 1]:
                    best[end + 1], come[end + 1], piece[end + 1] = total, s, int(value[node])
        to = min(s + width, n)
        if not known and best[s] + unknown > best[to]:
            best[to], come[to], piece[to] = best[s] + unknown, s, -1
    edges, end = [], n
    while end:
        edges.append((come[end], end, piece[end]))
        end = come[end]
    return edges[::-1]


def _with_markers(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with marker characters as spaces and a space before each that is not empty."""
    if (data == 0xE2).any() and MARKER.encode() in (raw := data.tobytes()):
        texts = [raw[a:b].replace(MARKER.encode(), b" ") for a, b in zip(at[:-1], at[1:])]
        data, at = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
    full = np.flatnonzero(np.diff(at))
    return np.insert(data, at[full], 0x20), at + np.searchsorted(full, np.arange(len(at)), side="left")


def encode_group(p: Pieces, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(ids of all texts, offset of each text in them, the normalised bytes they stand for)."""
    data, at = _with_markers(data, at)
    if not len(data):
        return np.empty(0, np.int64), np.zeros(len(at), np.int64), data
    space = data == 0x20
    first = np.zeros(len(data), bool)
    first[1:] = space[1:] & ~space[:-1]
    first[at[:-1][np.diff(at) > 0]] = True
    start = np.flatnonzero(first)
    end = np.append(start[1:], len(data))
    back, where = names_of(data, start, end)
    begin, size = start[where], end[where] - start[where]
    counts = np.zeros(len(where), np.int64)
    found: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
    low = 0
    for high in (8, 12, 16, 24, 32, LONG):
        pick = np.flatnonzero((size > low) & (size <= high))
        low = high
        for k in range(0, len(pick), 1 << 16):
            who = pick[k : k + (1 << 16)]
            grid = data[np.minimum(begin[who][:, None] + np.arange(high), len(data) - 1)]
            word, s, e, number = segment_words(p, grid, size[who])
            found.append(_ids(p, data, who[word], begin[who[word]] + s, begin[who[word]] + e, number))
    for who in np.flatnonzero(size > LONG):
        edges = np.array(segment_long(p, data[begin[who] : begin[who] + size[who]].tobytes()))
        found.append(_ids(p, data, np.full(len(edges), who), begin[who] + edges[:, 0], begin[who] + edges[:, 1], edges[:, 2]))
    word, ids = (np.concatenate(x) for x in zip(*found))
    order = np.argsort(word, kind="stable")
    word, ids = word[order], ids[order]
    counts = np.bincount(word, minlength=len(where))
    ids_at = np.cumsum(np.append(0, counts))
    n = counts[back]
    total = np.cumsum(np.append(0, n))
    out = ids[np.repeat(ids_at[back] - total[:-1], n) + np.arange(total[-1])]
    return out, total[np.searchsorted(start, at)], data


def _ids(p: Pieces, data: np.ndarray, word: np.ndarray, start: np.ndarray, end: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(word, id) of the edges, unknown ones as their bytes."""
    n = np.where(number < 0, end - start, 1)
    total = np.cumsum(n) - n
    place = np.repeat(start - total, n) + np.arange(n.sum())
    return np.repeat(word, n), np.where(np.repeat(number, n) < 0, p.byte_ids[data[np.minimum(place, len(data) - 1)]], np.repeat(number, n))


def decode_group(p: Pieces, ids: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of the texts of ids[at[i]:at[i+1]]; the first marker of a text is dropped."""
    n = p.text_at[ids + 1] - p.text_at[ids]
    total = np.cumsum(np.append(0, n))
    data = p.text[np.repeat(p.text_at[ids] - total[:-1], n) + np.arange(total[-1])]
    where = total[at]
    full = np.flatnonzero(np.diff(where))
    lead = where[full][data[where[full]] == 0x20]
    keep = np.ones(len(data), bool)
    keep[lead] = False
    return data[keep], where - np.searchsorted(lead, where)


def _strings(data: np.ndarray, at: np.ndarray) -> pa.Array:
    raw = data.tobytes()
    try:
        raw.decode()
        return pa.StringArray.from_buffers(len(at) - 1, pa.py_buffer(at.astype(np.int32)), pa.py_buffer(raw))
    except UnicodeDecodeError:
        return pa.array([raw[a:b].decode(errors="replace") for a, b in zip(at[:-1], at[1:])], pa.string())


def _lists(ids: np.ndarray, at: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(at.astype(np.int32)), pa.array(ids.astype(np.int32)))


def transcode(docs: DataFrame, p: Pieces, *, encode: bool = True, decode: bool = True, id_col: str = "doc_id", text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """The id column and, by what is asked for, ``ids`` (array<int>) of the text and ``decoded``, the text of the ids.

    Without encode, docs has the ids.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    shared = docs.sparkSession.sparkContext.broadcast(p)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = shared.value
        for batch in batches:
            column = batch.column(1)
            if encode:
                for first, after, data, at in text_groups(column, GROUP):
                    ids, ids_at, _ = encode_group(pieces, data, at)
                    out = [batch.column(0).slice(first, after - first), _lists(ids, ids_at)]
                    yield pa.RecordBatch.from_arrays(out + ([_strings(*decode_group(pieces, ids, ids_at))] if decode else []), names)
            elif batch.num_rows:
                column = column.fill_null([]) if column.null_count else column
                at = column.offsets.to_numpy().astype(np.int64)
                ids = column.values.to_numpy()[at[0] : at[-1]].astype(np.int64)
                if len(ids) and not 0 <= ids.min() <= ids.max() < len(pieces.score):
                    raise ValueError("an id is not of this vocabulary")
                yield pa.RecordBatch.from_arrays([batch.column(0), _strings(*decode_group(pieces, ids, at - at[0]))], names)

    names = [id_col, *["ids"] * encode, *["decoded"] * decode]
    kinds = [f"{id_col} {kind}", *["ids array<int>"] * encode, *["decoded string"] * decode]
    return docs.select(id_col, text_col if encode else ids_col).mapInArrow(run, ", ".join(kinds))
