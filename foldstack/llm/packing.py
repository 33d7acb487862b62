"""Best-fit packing of token sequences under several capacities.

Documents become token ids and pieces of at most a sequence's length; only lengths, checksums and keys travel to the
packing. Pieces are dealt by a hash into groups of bounded size, and each group is packed in one task: longest first,
each into the open sequence that suits it best among those that can hold it under every capacity (tokens, documents,
attention cost). What suits best is the smallest norm of the residual capacities, or the largest weighted dot product
of the piece's demands and the residuals. Sequences with equal residuals are one entry, so a choice looks at distinct
residuals only.
"""

from __future__ import annotations

import array
import json
import re
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import narrow, released, store, whole

TOKENS = 4096
END = 1
#: Pieces packed together in one task, on average.
GROUP = 150_000
#: Word pieces whose ids a task remembers at most; it then forgets all and goes on.
REMEMBERED = 500_000
#: Bytes of text encoded at a time.
BATCH_BYTES = 1 << 23

#: Words of printable ASCII and the letters of Latin-1; the vocabulary's rule for such words in lower case (fixed by
#: the file), and its stand-ins for the bytes that no such letter shares with a printable character.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
_PIECE = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_BYTES = {b: 290 + b - 0x80 for b in range(0x80, 0xA1)} | {0xAD: 323}


#: Normaliser and splitting rule of the vocabularies whose words can be coded one by one.
_NORMALIZER = {
    "type": "Sequence",
    "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}],
}
_SPLIT = {
    "type": "Sequence",
    "pretokenizers": [
        {
            "type": "Split",
            "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"},
            "behavior": "Removed",
            "invert": True,
        },
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}


@dataclass(frozen=True)
class Capacity:
    """What a sequence holds; ``None`` is no limit of its own. Weights are those of the score."""

    tokens: int = TOKENS
    documents: int | None = None
    attention: int | None = None
    weights: tuple[float, float, float] = (1.0, 0.0, 0.0)
    rule: str = "norm"

    def limits(self) -> np.ndarray:
        return np.array([self.tokens, self.documents or self.tokens, self.attention or self.tokens**2], dtype=np.int64)


#: Production packing: the token limit binds, documents and attention cost weigh in the choice.
PRODUCTION = Capacity(weights=(1.0, 0.3, 0.5))


class Encoder:
    """Ids of texts, found once per distinct word where the vocabulary never joins over white space.

    That is so for the normaliser and splitting rule above; with any other, whole texts go through the tokenizer.

    Arrow splits and numbers the words of a batch. A plain word is cut by the vocabulary's own rule (``_PIECE``, after
    lower-casing) and its pieces go straight to the merge model; any other word goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        rules = json.loads(self.tokenizer.to_str())
        self.by_words = rules["normalizer"] == _NORMALIZER and rules["pre_tokenizer"] == _SPLIT
        self.known: dict[str, bytes] = {}

    def _piece(self, piece: str) -> bytes:
        found = self.known.get(piece)
        if found is None:
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTES)
            ids = [t.id for t in self.tokenizer.model.tokenize(shown)]
            found = self.known[piece] = array.array("I", ids).tobytes()
        return found

    def _words(self, words: list[str]) -> list[bytes]:
        if len(self.known) > REMEMBERED:
            self.known = {}
        out, others, plain = [b""] * len(words), [], _PLAIN.fullmatch
        for i, word in enumerate(words):
            if plain(word) and "<|" not in word:
                out[i] = b"".join(map(self._piece, _PIECE.findall(word.lower())))
            else:
                others.append(i)
        found = self.tokenizer.encode_batch_fast([words[i] for i in others], add_special_tokens=False)
        for i, encoding in zip(others, found):
            out[i] = np.array(encoding.ids, dtype="<u4").tobytes()
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids one after another, and where each text's ids begin and end."""
        if not self.by_words:
            found = [x.ids for x in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
            bounds = np.cumsum([0, *map(len, found)])
            return np.fromiter((i for ids in found for i in ids), "<u4", int(bounds[-1])), bounds
        split = pc.ascii_split_whitespace(texts)
        coded = split.flatten().dictionary_encode()
        known = self._words(coded.dictionary.to_pylist())
        words = np.frombuffer(b"".join(known), dtype="<u4")
        lengths = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts = np.cumsum(lengths) - lengths
        codes = coded.indices.to_numpy()
        sizes = lengths[codes]
        ends = np.cumsum(sizes)
        ids = words[np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts[codes] - ends + sizes, sizes)]
        bounds = np.concatenate([np.zeros(1, np.int64), ends])[split.offsets.to_numpy() - split.offsets[0].as_py()]
        return ids, bounds


def pieces(docs: DataFrame, vocabulary: str, text: str = "text", doc_id: str = "doc_id", tokens: int = TOKENS) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)``: every document's ids and an end id, cut only beyond ``tokens``."""

    def cut(encoder: Encoder, ids: pa.Array, texts: pa.Array) -> pa.RecordBatch:
        found, bounds = encoder.encode(texts)
        rows, numbers = [], []
        for row in range(len(texts)):
            data = found[bounds[row] : bounds[row + 1]].tobytes() + END.to_bytes(4, "little")
            for number, start in enumerate(range(0, len(data), 4 * tokens)):
                part = data[start : start + 4 * tokens]
                numbers.append(row)
                rows.append((number, start // 4, len(part) // 4, zlib.crc32(part)))
        piece, start, length, crc = (pa.array(x, pa.int64()) for x in zip(*rows))
        return pa.record_batch(
            [ids.take(pa.array(numbers, pa.int32())), piece.cast(pa.int32()), start, length, crc],
            names=["doc_id", "piece", "start", "length", "ids_crc32"],
        )

    def run(batches):
        encoder = Encoder(vocabulary)
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            bytes_before = np.cumsum(np.concatenate([[0], pc.binary_length(texts).to_numpy()]))
            at = 0
            while at < len(texts):  # some texts at a time, one at least
                upto = max(at + 1, int(np.searchsorted(bytes_before, bytes_before[at] + BATCH_BYTES, "right")) - 1)
                yield cut(encoder, ids.slice(at, upto - at), texts.slice(at, upto - at))
                at = upto

    rows = narrow(docs, doc_id=doc_id, text=whole(text))
    return rows.mapInArrow(released(run), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: np.ndarray, capacity: Capacity) -> tuple[np.ndarray, np.ndarray]:
    """Sequence number and offset of each piece. A piece that breaks a capacity alone raises.

    Longest first; equal lengths in the order given. Ties between sequences fall to the fewest tokens left, then the
    residuals met first.
    """
    limits = capacity.limits()
    order = np.argsort(-lengths, kind="stable")
    if len(lengths) and (lengths.max() > limits[0] or lengths.max() ** 2 > limits[2] or limits[1] < 1):
        raise ValueError("a piece is larger than a sequence's capacity")
    weights = np.array(capacity.weights) / limits
    sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    room = np.zeros((1024, 3), np.int64)  # distinct residuals of open sequences; unused rows hold none
    where: dict[tuple, int] = {}
    holders: list[list[int]] = [[] for _ in range(1024)]
    free = list(range(1023, -1, -1))
    used = 0
    filled: list[int] = []
    for at in order:
        size = int(lengths[at])
        demand = np.array([size, 1, size * size], dtype=np.int64)
        left = room[:used] - demand
        fits = (left >= 0).all(axis=1) if used else np.zeros(0, bool)
        if fits.any():
            some = np.flatnonzero(fits)
            if capacity.rule == "dot":
                score = -(room[some] * weights * (demand * weights)).sum(axis=1)
            else:
                score = ((left[some] * weights) ** 2).sum(axis=1)
            slot = int(some[np.lexsort((left[some, 0], score))[0]])
            number = holders[slot].pop()
            state = left[slot]
            if not holders[slot]:
                del where[tuple(int(x) for x in room[slot])]
                room[slot] = -1
                free.append(slot)
        else:
            number = len(filled)
            filled.append(0)
            state = limits - demand
        sequence[at], offset[at] = number, filled[number]
        filled[number] += size
        key = tuple(int(x) for x in state)
        if key[0] and key[1] and key[2]:
            slot = where.get(key)
            if slot is None:
                if not free:
                    room = np.concatenate([room, np.full_like(room, -1)])
                    free = list(range(len(room) - 1, len(holders) - 1, -1))
                    holders += [[] for _ in range(len(room) - len(holders))]
                slot = free.pop()
                used = max(used, slot + 1)
                where[key] = slot
                room[slot] = key
            holders[slot].append(number)
    return sequence, offset


def pack(rows: DataFrame, capacity: Capacity = Capacity(), group: int = GROUP) -> DataFrame:
    """``rows`` (with ``doc_id, piece, length``) plus ``sequence_id`` and ``offset``.

    Groups are dealt by a hash, so a copied document or a hot source is spread like any other. Each leaves its last
    sequences partly filled, which costs a few sequences per ``group`` pieces. Rows that repeat a key are packed as
    they are. No rows give no sequences.
    """
    rows = store(rows, "pack-pieces")
    groups = max(1, -(-rows.count() // group))
    names = rows.columns
    dealt = rows.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece", "start"), F.lit(groups)))

    def run(key, table):
        table = table.sort_by([("length", "descending"), ("doc_id", "ascending"), ("piece", "ascending")])
        sequence, offset = best_fit(table.column("length").to_numpy(), capacity)
        number = sequence * groups + key[0].as_py()
        return table.select(names).append_column("sequence_id", pa.array(number)).append_column("offset", pa.array(offset))

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return dealt.groupBy("group").applyInArrow(run, f"{fields}, sequence_id long, offset long")


def report(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Pieces of all documents with their places, under the production capacities.

    A missing text is empty and holds its end id alone; a very long one is cut into pieces; a missing id is an id of
    its own; repeated rows are packed one by one; an empty table gives none, and other columns do not matter.
    """
    return pack(pieces(docs, vocabulary), PRODUCTION)
