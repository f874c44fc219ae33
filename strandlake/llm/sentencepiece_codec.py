"""SentencePiece encoding and decoding with the tokenizers library as backend.

The model's protobuf is parsed here (no sentencepiece needed to encode): normaliser, metaspace marker, piece scores and byte
fallback are rebuilt as a tokenizers model, unigram or BPE by the model's own type. Texts are normalised whole and cut before each
marker run, which no piece crosses (checked; else texts are encoded whole); distinct chunks are encoded once, in
multithreaded batches. ``verify`` compares ids and decoded text with the sentencepiece library.

Defined cases: a null text counts as empty and has no ids; pieces of control type are never matched in a text; characters
without a piece fall back to bytes, or to the unknown id where the model has no byte pieces; other columns are ignored, whatever their
names; repeated rows are encoded each and a null doc_id is returned as it is; texts of any length are encoded whole; an empty table gives no rows. Models with white space as suffix raise ValueError.
"""

from __future__ import annotations

import os
import re
import struct
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandlake.llm.common import arrow_map
from strandlake.llm.tokens import ChunkCache

MARK = "▁"
UNIGRAM, BPE = 1, 2
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; fixed-width values stay bytes."""

    def varint() -> int:
        nonlocal at
        shift = value = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            if byte < 128:
                return value
            shift += 7

    at = 0
    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(kind)
        if size is None:
            if kind != 2:
                raise ValueError(f"wire type {kind} isn't known")
            size = varint()
        if at + size > len(data):
            raise ValueError("the message is cut off")
        yield key >> 3, data[at : at + size]
        at += size


@dataclass
class PieceModel:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    types: list[int] = field(default_factory=list)
    kind: int = UNIGRAM
    byte_fallback: bool = False
    suffix_space: bool = False
    unk_surface: str = " ⁇ "
    charsmap: bytes = b""
    dummy_prefix: bool = True
    squeeze: bool = True
    escape: bool = True


def parse_model(data: bytes) -> PieceModel:
    """A serialised SentencePiece model."""
    model = PieceModel()
    for number, value in _fields(data):
        if number == 1:
            got = dict(_fields(value))
            model.pieces.append(got.get(1, b"").decode())
            model.scores.append(struct.unpack("<f", got.get(2, b"\0\0\0\0"))[0])
            model.types.append(got.get(3, NORMAL))
        elif number == 2:
            got = dict(_fields(value))
            model.kind, model.byte_fallback, model.suffix_space = got.get(3, UNIGRAM), bool(got.get(35, 0)), bool(got.get(24, 0))
            model.unk_surface = got[44].decode() if 44 in got else model.unk_surface
        elif number == 3:
            got = dict(_fields(value))
            model.charsmap, model.dummy_prefix, model.squeeze, model.escape = got.get(2, b""), bool(got.get(3, 1)), bool(got.get(4, 1)), bool(got.get(5, 1))
    if model.suffix_space or model.kind not in (UNIGRAM, BPE) or not model.escape:
        raise ValueError("only unigram and BPE models with a marker in front of words are supported")
    return model


def merges(model: PieceModel) -> list[tuple[str, str]]:
    """BPE merges by descending score of the merged piece: each way to make a piece out of two."""
    known = {p: i for i, (p, t) in enumerate(zip(model.pieces, model.types, strict=True)) if t in (NORMAL, UNUSED)}
    found = []
    for piece, i in known.items():
        for k in range(1, len(piece)):
            if piece[:k] in known and piece[k:] in known:
                found.append((-model.scores[i], i, known[piece[:k]], piece[:k], piece[k:]))
    return [(a, b) for *_, a, b in sorted(found)]


class Codec:
    """Encoder and decoder of one model; ``threads`` of the Rust pool encode a batch."""

    def __init__(self, path: str, threads: int = 2):
        os.environ["TOKENIZERS_PARALLELISM"], os.environ["RAYON_NUM_THREADS"] = "true", str(threads)
        from tokenizers import Regex, Tokenizer, decoders, models, normalizers

        with open(path, "rb") as f:
            self.model = m = parse_model(f.read())
        unknown = next((i for i, t in enumerate(m.types) if t == UNKNOWN), 0)
        steps = [normalizers.Precompiled(m.charsmap)] if m.charsmap else []
        if m.squeeze:
            steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
        steps += [normalizers.Prepend(MARK)] * m.dummy_prefix + [normalizers.Replace(" ", MARK)]
        self.normalizer = normalizers.Sequence(steps)
        hidden = {i for i, t in enumerate(m.types) if t in (CONTROL, UNKNOWN)}
        if m.kind == BPE:
            vocab = {p: i for i, p in enumerate(m.pieces)}
            core = models.BPE(vocab=vocab, merges=merges(m), unk_token=m.pieces[unknown], fuse_unk=True, byte_fallback=m.byte_fallback)
        else:
            # a piece that no text may match keeps its id under a name that no text can hold
            core = models.Unigram([(f"\0{i}" if i in hidden and i != unknown else p, s) for i, (p, s) in enumerate(zip(m.pieces, m.scores, strict=True))], unk_id=unknown, byte_fallback=m.byte_fallback)
        self.tokenizer = Tokenizer(core)
        self.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *[decoders.Strip(" ", 1, 0)] * m.dummy_prefix])
        self.unknown, self.skipped = unknown, hidden - {unknown}
        self.surface = [b"" if i in self.skipped else m.unk_surface.encode() if i == unknown else bytes([int(p[3:5], 16)]) if t == BYTE else p.replace(MARK, " ").encode() for i, (p, t) in enumerate(zip(m.pieces, m.types, strict=True))]
        users = sorted((p for p, t in zip(m.pieces, m.types, strict=True) if t == USER_DEFINED), key=len, reverse=True)
        self.users = re.compile("|".join(map(re.escape, users))) if users else None
        self.ids = {p: i for i, p in enumerate(m.pieces)}
        self.cuts = not any(MARK in p.lstrip(MARK) for p in m.pieces) and (m.kind == BPE or all(len(set(p)) > 1 or len(p) == 1 for p in m.pieces if p.startswith(MARK)))
        self.cache = ChunkCache(self._encode_chunks)
        # words between single spaces, where a space is all that the normaliser changes; a word from a line feed on has no marker
        self.lines = not any("\n" in p for p in m.pieces)
        self.words = ChunkCache(lambda ws: self._encode_chunks([w if self.lines and w[:1] == "\n" else MARK + w for w in ws]), limit=800_000) if self.cuts and m.dummy_prefix and not m.charsmap and not m.squeeze else None

    def _encode_chunks(self, chunks: list[str]) -> list[list[int]]:
        if not self.users:
            return [e.ids for e in self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)]
        parts, plan = [], []  # user-defined pieces are taken out first, the longest at each place
        for chunk in chunks:
            at, own = 0, []
            for m in self.users.finditer(chunk):
                own += [(len(parts), None)] if m.start() > at else []
                parts += [chunk[at : m.start()]] if m.start() > at else []
                own.append((None, self.ids[m[0]]))
                at = m.end()
            if at < len(chunk):
                own.append((len(parts), None))
                parts.append(chunk[at:])
            plan.append(own)
        got = [e.ids for e in self.tokenizer.encode_batch_fast(parts, add_special_tokens=False)]
        return [[i for k, user in own for i in (got[k] if user is None else [user])] for own in plan]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text."""
        out: list[np.ndarray] = [np.zeros(0, dtype=np.int32)] * len(texts)
        plain = [i for i, t in enumerate(texts) if self.words and t and t[0] != " " and "  " not in t and MARK not in t]
        other = sorted(set(range(len(texts))) - set(plain))
        for chosen, encode in ((plain, self._encode_words), (other, self._encode_normalised)):
            ids, bounds = encode([texts[i] for i in chosen])
            for i, a, b in zip(chosen, bounds[:-1], bounds[1:], strict=True):
                out[i] = ids[a:b]
        return out

    def _encode_words(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.lines:  # no piece holds a line feed, so none crosses it
            texts = [t.replace("\n", " \n") for t in texts]
        return self.words([t.encode("utf-8").split(b" ") for t in texts]) if texts else (np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64))

    def _encode_normalised(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        plain = [self.normalizer.normalize_str(t) if t else "" for t in texts]
        if self.model.squeeze:
            plain = ["" if p == MARK else p for p in plain]
        chunks = [re.findall(f"{MARK}*[^{MARK}]+|{MARK}+$", p) if self.cuts else [p] * bool(p) for p in plain]
        return self.cache([[c.encode("utf-8") for c in own] for own in chunks])

    def decode(self, texts: list[np.ndarray]) -> list[str]:
        """The text of each list of ids: control ids have none, the unknown id has the model's own surface."""
        return [self._joined(ids.tolist()) for ids in texts]

    def _joined(self, ids: list[int]) -> str:
        """Pieces and fallback bytes joined; the library's decoder takes texts whose bytes are no UTF-8."""
        try:
            text = b"".join(map(self.surface.__getitem__, ids)).decode("utf-8")
        except UnicodeDecodeError:
            names = self.model.pieces
            return self.decoder.decode([self.model.unk_surface if i == self.unknown else names[i] for i in ids if i not in self.skipped])
        return text[1:] if self.model.dummy_prefix and text[:1] == " " else text


@lru_cache(maxsize=1)
def kept_codec(path: str, threads: int) -> Codec:
    """The codec of a Python worker, for all tasks that it runs."""
    return Codec(path, threads)


def encode_documents(docs: DataFrame, model_path: str, threads: int = 2, verify: bool = True) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 (little-endian unsigned 32-bit ids), decoded_sha256, round_trip (decoded text equals the input), and
    with ``verify`` parity (ids and decoded text equal the sentencepiece library's; else null)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import hashlib

        codec, other = kept_codec(model_path, threads), None
        if verify:
            import sentencepiece

            other = sentencepiece.SentencePieceProcessor(model_file=model_path)
        for whole in batches:
            for begin in range(0, whole.num_rows, 500):
                batch = whole.slice(begin, 500)
                texts = [t or "" for t in batch.column(1).to_pylist()]
                own = codec.encode(texts)
                back = codec.decode(own)
                parity = pa.nulls(len(own), pa.bool_())
                if other:
                    theirs = other.encode(texts, num_threads=1)
                    parity = pa.array([x.tolist() == y and t == u for x, y, t, u in zip(own, theirs, back, other.decode(theirs), strict=True)], pa.bool_())
                cols = [pa.array([len(x) for x in own], pa.int64()), pa.array([zlib.crc32(x.astype("<u4")) for x in own], pa.int64()), pa.array([hashlib.sha256(t.encode()).hexdigest() for t in back], pa.string()), pa.array([t == u for t, u in zip(texts, back, strict=True)], pa.bool_()), parity]
                yield pa.record_batch([batch.column(0), *cols], names=["doc_id", "n_tokens", "ids_crc32", "decoded_sha256", "round_trip", "parity"])

    return arrow_map(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")), run, "doc_id long, n_tokens long, ids_crc32 long, decoded_sha256 string, round_trip boolean, parity boolean")
