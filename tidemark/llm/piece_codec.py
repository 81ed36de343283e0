"""SentencePiece (BPE) encoding that keeps byte offsets, and decoding.

A text is normalised by the longest prefix found in the model's compiled
character map; every normalised character records which original bytes it came
from. The library merges the normalised text in segments that no piece can cross
(white space marks a segment's start), so a segment's pieces are computed once
and kept. Each piece is projected through the recorded alignment to a span of
original bytes.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from sentencepiece import SentencePieceProcessor
from sentencepiece import sentencepiece_model_pb2 as model_pb

from tidemark.llm.chunks import columns

SPACE = "▁"
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
KEPT_SEGMENTS = 600_000
PIECES = "doc_id long, n_tokens long, ids array<int>, starts array<long>, ends array<long>, decoded string"
TOKENS = "doc_id long, n_tokens long, ids array<int>, round_trip boolean"
DIGESTS = "doc_id long, n_tokens long, n_bytes_spanned long, ids_sha256 string, decoded_sha256 string"


class CharMap:
    """The compiled character map: a double-array trie and the replacement strings it points to."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little") if blob else 0
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.strings = blob[4 + size :]

    def longest(self, text: bytes, at: int) -> tuple[int, bytes] | None:
        """(bytes consumed, replacement) of the longest entry that text[at:] begins with."""
        units, found = self.units, None
        if not units:
            return None
        node = (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(at, len(text)):
            node ^= text[i]
            if node >= len(units):
                break
            unit = units[node]
            if unit & 0x800000FF != text[i]:
                break
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit & 256:
                found = i + 1 - at, units[node] & 0x7FFFFFFF
        if found is None:
            return None
        return found[0], self.strings[found[1] : self.strings.index(0, found[1])]


class Codec:
    """Encoder and decoder of one model, given as its serialised bytes."""

    def __init__(self, model: bytes):
        proto = model_pb.ModelProto.FromString(model)
        self.pieces = [p.piece for p in proto.pieces]
        self.kinds = [p.type for p in proto.pieces]
        if proto.trainer_spec.model_type != 2 or not proto.trainer_spec.byte_fallback or UNUSED in self.kinds or USER in self.kinds or proto.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with byte pieces, without unused or user-defined pieces and with white space in front are supported")
        self.ids = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == NORMAL}
        self.special = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k != NORMAL}
        self.unknown = self.kinds.index(UNKNOWN)
        self.unknown_text = proto.trainer_spec.unk_surface if proto.trainer_spec.HasField("unk_surface") else " ⁇ "
        self.begin, self.end = self.special[proto.trainer_spec.bos_piece or "<s>"], self.special[proto.trainer_spec.eos_piece or "</s>"]
        spec = proto.normalizer_spec
        self.map, self.dummy = CharMap(spec.precompiled_charsmap), spec.add_dummy_prefix
        self.trim, self.escape = spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.bytes_of = {self.special[f"<0x{b:02X}>"]: b for b in range(256)}
        crosses = any(SPACE in p.lstrip(SPACE) for p in self.ids)
        self.segments = re.compile(".+" if crosses else f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+", re.DOTALL).findall
        self.plain = not self.map.units and not self.trim and self.escape
        self.kept: dict[str, bytes] = {}
        self.texts = [b"" if k in (CONTROL, UNKNOWN) else bytes([self.bytes_of[i]]) if k == BYTE else p.replace(SPACE, " ").encode() for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True))]
        self.lengths = np.array([len(p) for p in self.pieces])
        self.is_byte = np.array(self.kinds) == BYTE
        self.continues = np.array([0x80 <= self.bytes_of.get(i, 0) < 0xC0 for i in range(len(self.pieces))])
        # the library merges segments that are already normalised: its own normalisation is turned off
        spec.precompiled_charsmap, spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces = b"", False, False, False
        self.merges = SentencePieceProcessor(model_proto=proto.SerializeToString())

    # normalisation

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """(normalised text, original byte offset at which each of its characters begins, and one for the end)."""
        if self.plain:
            if not text:
                return "", np.zeros(1, np.int64)
            size = np.ones(len(text), np.int64) if text.isascii() else np.frombuffer(text.encode("utf-32-le"), "<u4")
            if not text.isascii():
                size = 1 + (size > 0x7F).astype(np.int64) + (size > 0x7FF) + (size > 0xFFFF)
            at = np.concatenate([[0], np.cumsum(size)])
            return (SPACE if self.dummy else "") + text.replace(" ", SPACE), np.concatenate([[0], at]) if self.dummy else at
        raw, at, steps = text.encode(), 0, []
        while at < len(raw):
            hit = self.map.longest(raw, at)
            if hit is None:
                n = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
                hit = n, raw[at : at + n]
            steps.append((at, hit[1].decode()))
            at += hit[0]
        if self.trim:
            while steps and not steps[0][1].strip(" "):
                steps.pop(0)
        out, where, after_space = [], [], self.trim
        if steps and self.dummy:
            out.append(SPACE if self.escape else " ")
            where.append(steps[0][0])
        for start, piece in steps:
            if after_space:
                piece = piece.lstrip(" ")
            for c in piece:
                out.append(SPACE if c == " " and self.escape else c)
                where.append(start)
            if piece:
                after_space = self.trim and piece.endswith(" ")
        end = len(raw)
        if self.trim:
            while out and out[-1] in (SPACE, " "):
                out.pop()
                end = where.pop()
        return "".join(out), np.array([*where, end], np.int64)

    # merges

    def characters(self, ids: np.ndarray) -> np.ndarray:
        """Characters spelt by the ids up to and including each; a character in byte pieces counts at the last of them."""
        n = self.lengths[ids]
        spelt = np.flatnonzero(self.is_byte[ids])
        if len(spelt):
            goes_on = np.zeros(len(ids) + 1, bool)
            goes_on[:-1] = self.continues[ids]
            n[spelt] = ~goes_on[spelt + 1]
        return np.cumsum(n)

    def learn(self, segments: list[str]) -> None:
        """Ids of segments not met before. No piece crosses a segment's start, so one call merges them all."""
        if len(self.kept) + len(segments) > KEPT_SEGMENTS:
            self.kept.clear()
        ids = np.array(self.merges.encode("".join(segments)), "<u4")
        cuts = np.searchsorted(self.characters(ids), np.cumsum([len(x) for x in segments])) + 1
        raw, at = ids.tobytes(), 0
        for segment, cut in zip(segments, (cuts * 4).tolist(), strict=True):
            self.kept[segment] = raw[at:cut]
            at = cut

    def encode(self, text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, bytes]:
        """(ids with begin and end, start and end byte of each id in the text, decoded UTF-8).

        A character spelt in byte pieces: the last of them spans its bytes, those before it are empty spans.
        """
        normal, where = self.normalise(text)
        parts = self.segments(normal)
        found = list(map(self.kept.get, parts))
        if None in found:
            self.learn(list(dict.fromkeys([p for p, f in zip(parts, found, strict=True) if f is None])))
            found = [f or self.kept[p] for p, f in zip(parts, found, strict=True)]
        ids = np.frombuffer(b"".join(found), "<u4")
        ends = where[self.characters(ids)] if len(ids) else np.zeros(0, np.int64)
        starts = np.concatenate([where[:1], ends[:-1]]) if len(ids) else ends
        decoded = b"".join(map(self.texts.__getitem__, ids.tolist()))
        if self.dummy and decoded[:1] == b" ":
            decoded = decoded[1:]
        all_ids = np.concatenate([[self.begin], ids, [self.end]]).astype("<u4")
        return all_ids, np.concatenate([[0], starts, where[-1:]]), np.concatenate([[0], ends, where[-1:]]), decoded

    # decoding

    def text_of(self, ids: list[int]) -> str:
        out, run = [], bytearray()
        for i in [*ids, None]:
            if i in self.bytes_of:
                run.append(self.bytes_of[i])
                continue
            if run:
                out.append(replaced(bytes(run)))
                run.clear()
            if i is not None and self.kinds[i] != CONTROL:
                out.append(self.unknown_text if i == self.unknown else self.pieces[i].replace(SPACE, " "))
        return "".join(out)

    def decode(self, ids: list[int]) -> str:
        """Text of any list of ids; the space put in front of the first piece goes."""
        rest = list(ids)
        while rest and self.kinds[rest[0]] == CONTROL:
            rest.pop(0)
        text = self.text_of(rest)
        if rest and self.dummy and rest[0] != self.unknown and rest[0] not in self.bytes_of:
            text = text.removeprefix(" ")
        return text


def replaced(raw: bytes) -> str:
    """UTF-8 with one replacement character for each byte that is no part of a character."""
    return raw.decode("utf-8", "surrogateescape").encode("utf-16", "surrogatepass").decode("utf-16", "replace") if not raw.isascii() and b"\xed" in raw else re.sub("[\udc80-\udcff]", "�", raw.decode("utf-8", "surrogateescape"))


@lru_cache(maxsize=2)
def codec(model: bytes) -> Codec:
    return Codec(model)


def read_model(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode_documents(docs: DataFrame, model_path: str, outputs: str = PIECES) -> DataFrame:
    """Encode each whole text with begin and end ids and decode it again.

    docs: doc_id long, text string; other columns are not read. One row for each input row, also of repeated ids.
    Columns: doc_id, n_tokens, ids, starts, ends (byte spans of the text; begin and end ids have empty spans),
    decoded. With outputs=DIGESTS, SHA-256 of the ids (little-endian unsigned 32-bit) and of the decoded UTF-8, and the
    bytes covered by spans, in place of the arrays; with outputs=TOKENS, the ids and whether they decode to the text. A null text counts as empty: begin and end id alone.
    The driver reads the model file, some hundred KB, and ships its bytes with the task.
    """
    model = read_model(model_path)
    schema = outputs

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(model)
        for batch in batches:
            names = [f.split()[0] for f in schema.split(", ")]
            out: dict[str, list] = {n: [] for n in names}
            ids_in = batch.column("doc_id")
            done, texts = 0, batch.column("text")
            for row in range(batch.num_rows):
                text = texts[row].as_py() or ""
                ids, starts, ends, decoded = c.encode(text)
                out["n_tokens"].append(len(ids))
                if schema == TOKENS:
                    out["ids"].append(ids.astype(np.int32))
                    out["round_trip"].append(decoded == text.encode())
                elif schema == DIGESTS:
                    out["n_bytes_spanned"].append(int((ends - starts).sum()))
                    out["ids_sha256"].append(hashlib.sha256(ids.tobytes()).hexdigest())
                    out["decoded_sha256"].append(hashlib.sha256(decoded).hexdigest())
                else:
                    out["ids"].append(ids.astype(np.int32))
                    out["starts"].append(starts)
                    out["ends"].append(ends)
                    out["decoded"].append(decoded.decode())
                done += len(decoded) if schema != DIGESTS else 0
                if done > 16 << 20:  # arrays of very long texts go on in parts
                    n = len(out["n_tokens"])
                    out["doc_id"] = ids_in.slice(row + 1 - n, n).to_pylist()
                    yield from columns(out, schema).to_batches()
                    out, done = {n: [] for n in names}, 0
            n = len(out["n_tokens"])
            if n:
                out["doc_id"] = ids_in.slice(batch.num_rows - n, n).to_pylist()
                yield from columns(out, schema).to_batches()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def public_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def op10_sentencepiece(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return encode_documents(docs, public_model(), DIGESTS).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "n_bytes_spanned")
