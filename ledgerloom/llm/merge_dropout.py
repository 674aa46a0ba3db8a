"""SentencePiece BPE encoding with seeded merge-dropout, and lossless decoding.

A candidate merge is a pair of neighbouring symbols whose joined text is a piece; the agenda takes the one of the best
score, the leftmost of equal ones. A candidate is skipped, for good, if a hash of (seed, doc_id, place of its segment in the
text, its three borders) falls below `rate`; a pair with other borders is another candidate. So each occurrence of a word
is cut in its own way, and encoding again gives the same ids. With rate 0 the ids are those of the SentencePiece library.

Texts are split where no piece holds the two characters on either side; no merge can cross such a place. What becomes of
a segment depends on its text and on which of its candidates are skipped: for each distinct segment of a block of texts the
candidates that any agenda could meet are listed once, each occurrence's are hashed, and of occurrences with one text and
one set of skips one agenda runs, together with those of other segments of the length, a merge in each a round. Segments
above `together` characters have too many candidates for that and run an agenda with a heap each. The model's pieces are
read on the driver from `path` and sent to the tasks; their number is the vocabulary's.

Fixed format: a text that isn't empty begins with an added space mark; the mark stands for a space; a character without
a piece, and the mark itself in a text, becomes byte pieces; decoding reverses all of it, so any text comes back.

Defined results: null and empty texts have no ids and decode to an empty text; a doc_id that is no integer counts by its
hash, a null one as 0; repeated rows get equal ids; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import pyspark.sql.types as T
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm._text import U, blocks, mix, raw

MARK = 0x2581
NEVER = np.int32(2**31 - 1)
#: Candidates that are hashed at once.
CANDIDATES = 1 << 18


#: A public model; any SentencePiece BPE model with byte pieces will do.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"


@dataclass(frozen=True)
class Dropout:
    rate: float = 0.1
    seed: int = 1
    #: Longer segments use a heap.
    together: int = 40


class Pieces:
    """A model's pieces as tables."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        n = model.get_piece_size()
        plain = [i for i in range(n) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        text = {i: model.id_to_piece(i) for i in plain}
        of = {t: i for i, t in text.items()}
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        scores = np.array([model.get_score(i) for i in range(n)])
        rank = np.unique(-scores, return_inverse=True)[1].astype(np.int32)
        # characters: class 0 has no piece of its own
        chars = sorted({c for t in text.values() for c in t if c in of})
        self.classes = np.zeros(0x110000, np.uint16)
        self.classes[[ord(c) for c in chars]] = np.arange(1, len(chars) + 1)
        self.char_ids = np.array([-1, *(of[c] for c in chars)], np.int32)
        self.together = np.zeros((len(chars) + 1, len(chars) + 1), bool)
        merges = {}
        for i, t in text.items():
            for k in range(1, len(t)):
                if t[:k] in of and t[k:] in of:
                    merges[of[t[:k]] << 32 | of[t[k:]]] = i
                self.together[self.classes[ord(t[k - 1])], self.classes[ord(t[k])]] = True
        self.together[0] = self.together[:, 0] = False
        self.rank = rank
        # a hash table with open addressing: -1 where a slot is free; each free slot takes one of the pairs that ask for it
        pairs = np.array(sorted(merges), np.int64)
        joined = np.array([merges[p] for p in pairs.tolist()], np.int32)
        self.bits = max(10, int(8 * len(pairs)).bit_length())
        self.slot_pair, self.slot_joined = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, -1, np.int32)
        left, slot = np.arange(len(pairs)), self._slot(pairs)
        while len(left):
            one = np.unique(slot[left], return_index=True)[1]
            take = left[one[self.slot_pair[slot[left[one]]] < 0]]
            self.slot_pair[slot[take]], self.slot_joined[slot[take]] = pairs[take], joined[take]
            left = np.setdiff1d(left, take)
            slot[left] = (slot[left] + 1) & (1 << self.bits) - 1
        out = [b""] * n
        for i, t in text.items():
            out[i] = t.replace(chr(MARK), " ").encode()
        for b, i in enumerate(self.byte_ids.tolist()):
            out[i] = bytes([b])
        self.bytes = np.frombuffer(b"".join(out), np.uint8)
        self.size = np.array([len(x) for x in out])
        self.at = np.cumsum(self.size) - self.size

    def _slot(self, pairs: np.ndarray) -> np.ndarray:
        return ((pairs.view(U) * U(0x9E3779B97F4A7C15)) >> U(64 - self.bits)).astype(np.int64)

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece of each pair's joined text, -1 where there is none."""
        pairs = left.astype(np.int64) << 32 | right.astype(np.int64)
        slot = self._slot(pairs)
        held = self.slot_pair[slot]
        out = np.where(held == pairs, self.slot_joined[slot], np.int32(-1))
        k = np.flatnonzero((held != pairs) & (held >= 0))
        while len(k):  # another pair is there: look one further on
            slot[k] = (slot[k] + 1) & (1 << self.bits) - 1
            held = self.slot_pair[slot[k]]
            same = held == pairs[k]
            out[k[same]] = self.slot_joined[slot[k[same]]]
            k = k[~same & (held >= 0)]
        return out


def border_hash(low: np.ndarray, middle: np.ndarray, high: np.ndarray) -> np.ndarray:
    return mix((low.astype(U) << U(42)) ^ (middle.astype(U) << U(21)) ^ high.astype(U))


def skipped(key: np.ndarray, borders: np.ndarray, rate: float) -> np.ndarray:
    """Whether the candidates with these borders are dropped, by the keys of their segments and the hashes of their borders."""
    if rate <= 0:
        return np.zeros(len(key), bool)
    if rate >= 1:
        return np.ones(len(key), bool)
    return mix(key ^ borders) < U(int(rate * 2**64))


def _borders(ids: np.ndarray, pieces: Pieces) -> list[np.ndarray]:
    """row, low, middle, high of all candidates that equally long segments can have, by row."""
    n, width = ids.shape
    span = np.full((n, width + 1, width + 1), -1, np.int32)  # the piece from low to high, -1 where there is none
    at = np.arange(width)
    span[:, at, at + 1] = ids
    found = []
    for size in range(2, width + 1):
        low = np.arange(width - size + 1)
        for left in range(1, size):
            a, b = span[:, low, low + left], span[:, low + left, low + size]
            r, k = np.nonzero((a >= 0) & (b >= 0))
            if len(r):
                piece = pieces.join(a[r, k], b[r, k])
                known = piece >= 0
                r, k = r[known], k[known]
                span[r, k, k + size] = piece[known]
                found.append((r, k, k + left, k + size))
    out = [np.concatenate(x) for x in zip(*found, strict=True)] if found else [np.zeros(0, np.int64)] * 4
    order = np.argsort(out[0], kind="stable")
    return [x[order] for x in out]


def _agendas(ids: np.ndarray, skips: np.ndarray, pieces: Pieces) -> list[tuple[np.ndarray, np.ndarray]]:
    """(rows, their symbols) of equally long segments, by the number of merges they took; ids: segments x characters.

    skips: the candidates that are dropped, as sorted numbers of row and borders (see _number).
    """
    n, width = ids.shape
    row, full = np.arange(n), width
    maybe = np.zeros(1 << 20, bool)  # a filter before the search: most candidates are not skipped
    maybe[skips & (1 << 20) - 1] = True
    border = np.broadcast_to(np.arange(width + 1, dtype=np.int32), (n, width + 1)).copy()
    out = []

    def candidates(r: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        piece = pieces.join(ids[r, j], ids[r, j + 1])
        rank = np.where(piece >= 0, pieces.rank[piece], NEVER)
        if len(skips):
            k = np.flatnonzero(piece >= 0)
            number = _number(row[r[k]], border[r[k], j[k]], border[r[k], j[k] + 1], border[r[k], j[k] + 2], full)
            near = np.flatnonzero(maybe[number & (1 << 20) - 1])
            k, number = k[near], number[near]
            rank[k[skips[np.minimum(np.searchsorted(skips, number), len(skips) - 1)] == number]] = NEVER
        return rank, piece

    if width > 1:
        r, j = np.repeat(row, width - 1), np.tile(np.arange(width - 1), n)
        rank, piece = (x.reshape(n, width - 1) for x in candidates(r, j))
    while ids.shape[1] > 1 and len(ids):
        best = rank.argmin(axis=1)
        line = np.arange(len(ids))
        done = rank[line, best] == NEVER
        if done.any():
            out.append((row[done], ids[done]))
            stay = ~done
            ids, border, rank, piece, row, best = ids[stay], border[stay], rank[stay], piece[stay], row[stay], best[stay]
            line = np.arange(len(ids))
            if not len(ids):
                break
        width = ids.shape[1]
        ids[line, best] = piece[line, best]
        keep = np.ones((len(ids), width + 1), bool)
        keep[line, best + 1] = False
        border = border[keep].reshape(len(ids), width)
        ids = ids[keep[:, :width]].reshape(len(ids), width - 1)
        if width == 2:
            break
        keep = np.ones((len(ids), width - 1), bool)
        keep[line, best] = False
        rank, piece = rank[keep].reshape(len(ids), width - 2), piece[keep].reshape(len(ids), width - 2)
        for k in (best - 1, best):  # the pairs that the new symbol is in
            r = np.flatnonzero((k >= 0) & (k < width - 2))
            rank[r, k[r]], piece[r, k[r]] = candidates(r, k[r])
    if len(ids):
        out.append((row, ids))
    return out


def _number(row: np.ndarray, low: np.ndarray, middle: np.ndarray, high: np.ndarray, width: int) -> np.ndarray:
    return ((row.astype(np.int64) * (width + 1) + low) * (width + 1) + middle) * (width + 1) + high


def _segments(ids: np.ndarray, of: np.ndarray, key: np.ndarray, pieces: Pieces, rate: float) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """The agendas of equally long segments: which one each occurrence has, and (agendas, their symbols) as in _agendas.

    ids: distinct segments x characters; of, key: segment and hash key of each occurrence.
    """
    width = ids.shape[1]
    row, *border = _borders(ids, pieces)
    first = np.searchsorted(row, np.arange(len(ids) + 1))
    n, hashes = np.diff(first)[of], border_hash(*border)
    upto = np.append(0, np.cumsum(n))
    drops = []  # (occurrence, candidate) of those that are skipped, a few candidates at a time
    low = 0
    while low < len(of):
        high = max(low + 1, int(np.searchsorted(upto, upto[low] + CANDIDATES, "right")) - 1)
        occurrence = np.repeat(np.arange(low, high), n[low:high])
        at = np.arange(len(occurrence)) + np.repeat(first[:-1][of[low:high]] - (upto[low:high] - upto[low]), n[low:high])
        k = np.flatnonzero(skipped(key[occurrence], hashes[at], rate))
        drops.append((occurrence[k], at[k]))
        low = high
    occurrence, at = (np.concatenate(x) for x in zip(*drops, strict=True))
    # a set of skips is named by a sum over its members, which a second sum confirms
    one, two = np.zeros(len(of), U), np.zeros(len(of), U)
    np.add.at(one, occurrence, mix(at.astype(U) + U(1)))
    np.add.at(two, occurrence, mix(at.astype(U) ^ U(0x5851F42D4C957F2D)))
    order = np.lexsort((two, one, of))
    new = np.ones(len(of), bool)
    new[1:] = (of[order][1:] != of[order][:-1]) | (one[order][1:] != one[order][:-1]) | (two[order][1:] != two[order][:-1])
    own = np.empty(len(of), np.int64)
    own[order] = np.cumsum(new) - 1
    speaks = order[new]
    member = np.full(len(of), -1)
    member[speaks] = np.arange(len(speaks))
    told = member[occurrence] >= 0
    skips = np.sort(_number(member[occurrence[told]], *(x[at[told]] for x in border), width))
    return own, _agendas(ids[of[speaks]], skips, pieces)


def agenda(ids: list[int], key: int, pieces: Pieces, rate: float) -> list[int]:
    """One segment's agenda with a heap."""
    n = len(ids)
    ids, high, after, before = list(ids), list(range(1, n + 1)), list(range(1, n + 1)), list(range(-1, n - 1))
    heap: list[tuple] = []
    one = lambda x: np.array([x])

    def offer(a: int, b: int) -> None:
        piece = int(pieces.join(one(ids[a]), one(ids[b]))[0])
        if piece >= 0 and not skipped(np.array([key], U), border_hash(one(a), one(b), one(high[b])), rate)[0]:
            heapq.heappush(heap, (int(pieces.rank[piece]), a, b, high[b], piece, ids[a], ids[b]))

    for a in range(n - 1):
        offer(a, a + 1)
    while heap:
        _, a, b, end, piece, x, y = heapq.heappop(heap)
        if ids[a] != x or ids[b] != y or after[a] != b or high[b] != end or high[a] != b:
            continue
        ids[a], high[a], after[a] = piece, end, after[b]
        ids[b] = -2
        if after[a] < n:
            before[after[a]] = a
        if before[a] >= 0:
            offer(before[a], a)
        if after[a] < n:
            offer(a, after[a])
    out, k = [], 0
    while k < n:
        out.append(ids[k])
        k = high[k]
    return out


def encode(column: pa.Array, doc_id: np.ndarray, pieces: Pieces, dropout: Dropout) -> tuple[np.ndarray, np.ndarray]:
    """All ids and each row's first id (one more than rows)."""
    data, offsets = raw(column)
    rows = len(offsets) - 1
    first_byte = (data & 0xC0) != 0x80
    chars = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    at = np.append(0, np.cumsum(first_byte))[offsets]  # each row's first character
    own_mark = chars == MARK
    chars = np.where(chars == 32, np.uint32(MARK), chars)
    full = np.flatnonzero(at[1:] > at[:-1])
    begins = at[full]
    chars = np.insert(chars, begins, MARK)
    own_mark = np.insert(own_mark, begins, False)
    at = at + np.searchsorted(begins, at, "left")
    classes = pieces.classes[chars]
    classes[own_mark] = 0
    n = len(chars)
    if not n:
        return np.zeros(0, np.int32), np.zeros(rows + 1, np.int64)
    new = np.ones(n, bool)
    new[1:] = ~pieces.together[classes[:-1], classes[1:]]
    new[at[:-1][full]] = True
    start = np.flatnonzero(new)
    end = np.append(start[1:], n)
    size = end - start
    row = np.searchsorted(at, start, "right") - 1
    place = start - at[row]
    # the key of each occurrence, which decides what it skips
    key = mix(mix(mix(doc_id.astype(np.int64).view(U) + U(dropout.seed))[row] ^ U(dropout.seed)) + place.astype(U))
    count = np.zeros(len(start), np.int64)
    found: list[tuple[np.ndarray, np.ndarray]] = []  # (segments, ids: segments x n)
    agenda_of = np.arange(len(start))  # the segment whose ids each one takes
    for width in np.unique(size).tolist():
        k = np.flatnonzero(size == width)
        if width == 1:
            c = classes[start[k]]
            found.append((k[c > 0], pieces.char_ids[c[c > 0]][:, None]))
            lone = k[c == 0]
            text, which = np.unique(chars[start[lone]], return_inverse=True)
            encoded = [pieces.byte_ids[list(chr(x).encode("utf-8"))] for x in text.tolist()]
            for n_bytes in {len(x) for x in encoded}:
                own = np.array([len(x) == n_bytes for x in encoded])
                at_ = np.flatnonzero(own[which])
                rows_ = np.zeros((len(text), n_bytes), np.int32)
                rows_[own] = np.stack([x for x in encoded if len(x) == n_bytes])
                found.append((lone[at_], rows_[which[at_]]))
            continue
        ids = pieces.char_ids[classes[start[k][:, None] + np.arange(width)[None, :]]]
        if width > dropout.together:
            found += [(np.array([s]), np.array([agenda(x, y, pieces, dropout.rate)], np.int32)) for s, x, y in zip(k.tolist(), ids.tolist(), key[k].tolist(), strict=True)]
            continue
        of = _equal_rows(ids)
        first = np.full(int(of.max()) + 1, len(k))
        np.minimum.at(first, of, np.arange(len(k)))
        own, done = _segments(ids[first], of, key[k], pieces, dropout.rate)
        speaks = np.full(int(own.max()) + 1, len(k))
        np.minimum.at(speaks, own, np.arange(len(k)))
        found += [(k[speaks[r]], x) for r, x in done]
        agenda_of[k] = k[speaks[own]]
    for k, ids in found:
        count[k] = ids.shape[1]
    own_at = np.cumsum(count) - count
    flat = np.empty(int(count.sum()), np.int32)
    for k, ids in found:
        flat[own_at[k][:, None] + np.arange(ids.shape[1])[None, :]] = ids
    n_ids = count[agenda_of]
    total = np.cumsum(n_ids)
    out = flat[np.arange(total[-1]) + np.repeat(own_at[agenda_of] - (total - n_ids), n_ids)]
    upto = np.append(0, total)[np.searchsorted(start, at)]
    return out, upto


def _equal_rows(ids: np.ndarray) -> np.ndarray:
    """A number for each row, the same for equal rows."""
    order = np.lexsort(ids.T)
    new = np.ones(len(ids), bool)
    new[1:] = (ids[order[1:]] != ids[order[:-1]]).any(axis=1)
    out = np.empty(len(ids), np.int64)
    out[order] = np.cumsum(new) - 1
    return out


def decode(ids: np.ndarray, first: np.ndarray, pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all rows and each row's first byte (one more than rows)."""
    size = pieces.size[ids].copy()
    # the added mark: a row's first piece loses its first byte
    full = np.flatnonzero(first[1:] > first[:-1])
    lead = first[:-1][full]
    at = pieces.at[ids]
    at[lead] += 1
    size[lead] -= 1
    total = np.cumsum(size)
    data = pieces.bytes[np.arange(total[-1] if len(total) else 0) + np.repeat(at - (total - size), size)]
    return data, np.append(0, total)[first]


def encode_documents(documents: DataFrame, path: str = MODEL, dropout: Dropout = Dropout()) -> DataFrame:
    """doc_id, ids, n_ids and lossless (decoding gives the text back, checked for each row)."""
    pieces = documents.sparkSession.sparkContext.broadcast(Pieces(path))
    kind = documents.schema["doc_id"]
    number = F.col("doc_id").cast("long") if isinstance(kind.dataType, T.IntegralType) else F.xxhash64("doc_id")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = pieces.value
        for batch in batches:
            for block in blocks(batch, most=1 << 22):
                text = block.column("text")
                ids, first = encode(text, np.asarray(block.column("number"), np.int64), known, dropout)
                data, offsets = raw(text)
                back, at = decode(ids, first, known)
                whole = data.tobytes() == back.tobytes() and bool((at == offsets).all())
                same = [True] * block.num_rows if whole else [data[a:b].tobytes() == back[c:d].tobytes() for a, b, c, d in zip(offsets[:-1], offsets[1:], at[:-1], at[1:], strict=True)]
                lists = pa.ListArray.from_arrays(first.astype(np.int32), pa.array(ids, pa.int32()))
                yield pa.record_batch({"doc_id": block.column("doc_id"), "ids": lists, "n_ids": np.diff(first), "lossless": pa.array(same, pa.bool_())})

    schema = T.StructType([kind, T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("n_ids", T.LongType()), T.StructField("lossless", T.BooleanType())])
    return documents.select("doc_id", "text", F.coalesce(number, F.lit(0)).alias("number")).mapInArrow(run, schema)


def decode_documents(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """doc_id and text of rows (doc_id, ids)."""
    pieces = encoded.sparkSession.sparkContext.broadcast(Pieces(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column("ids")
            lists = lists.fill_null([]) if lists.null_count else lists
            flat = np.asarray(lists.flatten(), np.int32)
            first = np.append(0, np.cumsum(np.asarray(pa.compute.list_value_length(lists), np.int64)))
            data, at = decode(flat, first, pieces.value)
            yield pa.record_batch({"doc_id": batch.column("doc_id"), "text": pa.array([data[a:b].tobytes().decode() for a, b in zip(at[:-1].tolist(), at[1:].tolist(), strict=True)], pa.string())})

    return encoded.select("doc_id", "ids").mapInArrow(run, T.StructType([encoded.schema["doc_id"], T.StructField("text", T.StringType())]))
