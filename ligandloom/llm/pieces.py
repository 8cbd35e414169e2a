"""SentencePiece encoding and decoding by a batched Viterbi search in numpy.

The best segmentation is the one whose pieces' scores in the model file add up to
most; of equal ones that with the longer last piece. A text is cut where no piece
can span (before a run of spaces, around line ends), the distinct words are
grouped by length, and the words of a group advance together: hashes of all
substrings that end at a position probe the sorted hashes of the pieces, and
one vectorised maximum over the piece lengths stores the back pointers.

A character without a piece becomes the pieces of its UTF-8 bytes. As in the
model, a space is written as U+2581 and one is put before the text; decoding takes it
away. A text that itself holds U+2581 gets a space back for it; every other text
is decoded to itself.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ligandloom.llm.tokens import grouped, mix

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Words times positions that are searched at once, and words that a worker remembers.
CELLS, MEMO = 1 << 15, 150_000
#: Characters of the texts whose words are collected together.
GROUP = 1 << 20
_BASE = np.uint64(0x100000001B3)


class Pieces(NamedTuple):
    keys: list[np.ndarray]  # for each length: sorted hashes of its pieces
    ids: list[np.ndarray]
    scores: list[np.ndarray]
    unknown: float
    byte_ids: np.ndarray  # piece of each byte
    spoken: list[bytes]  # bytes of each piece when decoded
    prefix: bool


def load(path: str = MODEL) -> Pieces:
    """The vocabulary of a model file. Read on the driver; it travels with the tasks (below 5 MB for 32,000 pieces)."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    proto = pb.ModelProto()
    with open(path, "rb") as f:
        proto.ParseFromString(f.read())
    if not proto.trainer_spec.byte_fallback or proto.normalizer_spec.precompiled_charsmap:
        raise ValueError("a model with byte fallback and without normalisation is needed")
    normal = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == 1]
    if any(re.search(f"[^{SPACE}]{SPACE}|\n", p) for _, p, _ in normal):
        raise ValueError("a piece reaches over a cut between words")
    by_length: dict[int, list] = {}
    for i, p, s in normal:
        by_length.setdefault(len(p), []).append((int(_hash(np.array([[ord(c) for c in p]]))[0]), i, s))
    keys, ids, scores = [], [], []
    for n in range(1, max(by_length) + 1):
        rows = sorted(by_length.get(n, []))
        keys.append(np.array([r[0] for r in rows], np.uint64))
        ids.append(np.array([r[1] for r in rows], np.int32))
        scores.append(np.array([r[2] for r in rows], float))
    if sum(len(np.unique(k)) for k in keys) != len(normal):
        raise ValueError("two pieces have one hash")
    byte_ids = np.zeros(256, np.int32)
    spoken = []
    for i, p in enumerate(proto.pieces):
        if p.type == 6:
            byte_ids[int(p.piece[3:5], 16)] = i
            spoken.append(bytes([int(p.piece[3:5], 16)]))
        else:
            spoken.append(b"" if p.type in (2, 3) else p.piece.replace(SPACE, " ").encode())
    return Pieces(
        keys, ids, scores, min(s for _, _, s in normal) - 10.0, byte_ids, spoken,
        proto.normalizer_spec.add_dummy_prefix,
    )


def _hash(codes: np.ndarray) -> np.ndarray:
    out = np.zeros(len(codes), np.uint64)
    for k in range(codes.shape[1]):
        out = out * _BASE + mix(codes[:, k].astype(np.uint64) + np.uint64(1))
    return out


def viterbi(model: Pieces, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of words of one length, a row of code points each, and where in the word each piece ends.

    -1 stands for a character without piece, -2 fills the rows on the left.
    """
    words, n = codes.shape
    column = np.arange(words)
    longest = min(len(model.keys), n)
    value = mix(codes.astype(np.uint64) + np.uint64(1)).T.copy()  # position, word
    best = np.full((n + 1, words), -np.inf)
    best[0] = 0
    back = np.zeros((n + 1, words), np.int8)
    piece = np.full((n + 1, words), -1, np.int32)
    block = max(1, CELLS // words)
    power = np.cumprod(np.r_[np.uint64(1), np.full(longest, _BASE)].astype(np.uint64))
    for at in range(1, n + 1, block):
        ends = np.arange(at, min(at + block, n + 1))
        gain = np.full((len(ends), longest, words), -np.inf)
        ident = np.full((len(ends), longest, words), -1, np.int32)
        sums = np.zeros((len(ends), words), np.uint64)
        for size in range(1, longest + 1):
            there = ends >= size
            rows = ends[there] - size
            sums[there] += value[rows] * power[size - 1]
            keys = model.keys[size - 1]
            if len(keys):
                place = np.minimum(np.searchsorted(keys, sums[there]), len(keys) - 1)
                hit = keys[place] == sums[there]
                slot = longest - size  # the longest piece first: a maximum takes the first of equal sums
                gain[there, slot] = np.where(hit, model.scores[size - 1][place], -np.inf)
                ident[there, slot] = np.where(hit, model.ids[size - 1][place], -1)
        alone = np.isneginf(gain[:, longest - 1])
        gain[:, longest - 1][alone] = model.unknown
        sizes = np.arange(longest, 0, -1)
        for k, end in enumerate(ends):
            usable = sizes <= end
            sums_to = gain[k, usable] + best[end - sizes[usable]]
            choice = sums_to.argmax(axis=0)
            best[end] = sums_to[choice, column]
            back[end] = sizes[usable][choice]
            piece[end] = ident[k, usable][choice, column]
    ids, stops = [], []
    end = np.full(words, n)
    while (end > 0).any():
        ids.append(np.where(end > 0, piece[end, column], -2))
        stops.append(end)
        end = end - np.where(end > 0, back[end, column], 0)
    return np.stack(ids[::-1], axis=1), np.stack(stops[::-1], axis=1)


def encode_words(model: Pieces, words: list[str]) -> dict[str, bytes]:
    """Piece ids of distinct words, as little-endian int32 bytes."""
    out: dict[str, bytes] = {}
    by_length: dict[int, list[str]] = {}
    for w in words:
        by_length.setdefault(len(w), []).append(w)
    for n, group in by_length.items():
        step = max(1, CELLS // n)
        for k in range(0, len(group), step):
            part = group[k : k + step]
            codes = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(part), n)
            ids, ends = viterbi(model, codes)
            real = ids > -2
            flat = ids[real].astype("<i4").tobytes()
            stops = (4 * np.cumsum(real.sum(axis=1))).tolist()
            out.update({w: flat[a:b] for w, a, b in zip(part, [0, *stops], stops)})
            for at in np.flatnonzero((ids == -1).any(axis=1)).tolist():
                w = part[at]
                out[w] = b"".join(
                    (np.array([i]) if i >= 0 else model.byte_ids[np.frombuffer(w[e - 1].encode(), np.uint8)])
                    .astype("<i4").tobytes()
                    for i, e in zip(ids[at][real[at]].tolist(), ends[at][real[at]].tolist())
                )
    return out


_CUT = re.compile(f"\n|{SPACE}+[^{SPACE}\n]*|[^{SPACE}\n]+")


class Encoder:
    def __init__(self, model: Pieces):
        self.model, self.memo = model, {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Piece ids of texts, as little-endian int32 bytes."""
        prefix = SPACE if self.model.prefix else ""
        cut = [_CUT.findall(prefix + t.replace(" ", SPACE)) if t else [] for t in texts]
        if len(self.memo) > MEMO:
            self.memo.clear()
        new = {w for words in cut for w in words if w not in self.memo}
        self.memo.update(encode_words(self.model, list(new)))
        return [b"".join(map(self.memo.__getitem__, words)) for words in cut]


def decode(model: Pieces, ids: np.ndarray, stops: np.ndarray) -> list[str]:
    """Texts of several id sequences, laid end to end; each ends at its place in ``stops``."""
    size = np.array([len(x) for x in model.spoken])
    begin = np.cumsum(size) - size
    sound = np.frombuffer(b"".join(model.spoken), np.uint8)
    n = size[ids]
    ends = np.cumsum(n)
    data = sound[np.repeat(begin[ids] - (ends - n), n) + np.arange(n.sum())].tobytes()
    cut = np.r_[0, ends][stops].tolist()
    out = [data[a:b].decode("utf-8", "replace") for a, b in zip([0, *cut], cut)]
    return [t[1:] if model.prefix and t.startswith(" ") else t for t in out]


def encode_column(model: Pieces, text: str | Column) -> Column:
    """array<int> of piece ids; null and empty texts have none."""

    @F.arrow_udf("array<int>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = Encoder(model)
        for texts in batches:
            lists = []
            for group in grouped(((t.as_py(),) for t in texts), 0, GROUP):
                lists += encoder.encode([t or "" for (t,) in group])
            offsets = np.r_[0, np.cumsum([len(x) // 4 for x in lists])].astype(np.int32)
            yield pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(lists), "<i4")))

    return run(F.col(text) if isinstance(text, str) else text)


def decode_column(model: Pieces, ids: str | Column) -> Column:
    """The text of an array of piece ids; null ids give the empty text."""

    @F.arrow_udf("string")
    def run(arrays: pa.Array) -> pa.Array:
        out: list[str] = []
        for k in range(0, len(arrays), 256):
            part = arrays.slice(k, 256)
            sizes = part.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            out += decode(model, part.flatten().to_numpy(zero_copy_only=False), np.cumsum(sizes))
        return pa.array(out, pa.string())

    return run(F.col(ids) if isinstance(ids, str) else ids)


def _coded(docs: DataFrame, text: str, key: str, path: str) -> DataFrame:
    """doc_id, text (decoded again), piece_ids, and whether the text came back; one worker does both ways."""
    model = load(path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(model)
        for batch in batches:
            at = 0
            for group in grouped(((t.as_py() or "",) for t in batch.column(1)), 0, GROUP):
                texts = [t for (t,) in group]
                lists = encoder.encode(texts)
                stops = np.cumsum([len(x) // 4 for x in lists])
                ids = np.frombuffer(b"".join(lists), "<i4")
                back = decode(model, ids, stops)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(at, len(texts)), pa.array(back, pa.string()),
                        pa.ListArray.from_arrays(pa.array(np.r_[0, stops].astype(np.int32)), pa.array(ids)),
                        pa.array([x == y for x, y in zip(back, texts)], pa.bool_()),
                    ],
                    ["doc_id", "text", "piece_ids", "same"],
                )
                at += len(texts)

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(F.col(key).alias("doc_id"), F.col(text).alias("text")).mapInArrow(
        run, f"doc_id {kind}, text string, piece_ids array<int>, same boolean"
    )


def encode_documents(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = MODEL) -> DataFrame:
    """doc_id, text (decoded again from the pieces), n_pieces and piece_ids of every row.

    Null texts are empty texts; repeated rows stay repeated.
    """
    return _coded(docs, text, key, path).select(
        "doc_id", "text", F.size("piece_ids").cast("bigint").alias("n_pieces"), "piece_ids"
    )


def encoding_digest(docs: DataFrame, text: str = "text", key: str = "doc_id", path: str = MODEL) -> DataFrame:
    """doc_id, n_pieces, n_byte_pieces, pieces_hash (of the ids), text_crc32 (of the decoded text) and round_trip."""
    model = load(path)
    low, high = int(model.byte_ids.min()), int(model.byte_ids.max())
    return _coded(docs, text, key, path).select(
        "doc_id",
        F.size("piece_ids").cast("bigint").alias("n_pieces"),
        F.size(F.filter("piece_ids", lambda i: i.between(low, high))).cast("bigint").alias("n_byte_pieces"),
        F.xxhash64("piece_ids").alias("pieces_hash"),
        F.crc32(F.col("text").cast("binary")).alias("text_crc32"),
        F.col("same").alias("round_trip"),
    )
