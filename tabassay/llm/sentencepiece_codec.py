"""SentencePiece encoding and decoding with spans into the original bytes.

The text is normalised here: at each place the longest prefix in the model's compiled character
map is replaced, and every normalised character remembers the original bytes it came from. Pieces
are then found unit by unit (a unit is a run of the space mark with what follows; no piece of the
vocabulary crosses its edges), each distinct unit once in a task's bounded memory, and projected
through the alignment to original byte spans.

Null and empty texts have only the closing ids asked for and decode to ''. Texts of any length are
encoded whole. Rows, repeated or not, stay; extra columns stay unless they bear an output's name,
which is then replaced. Empty tables give empty results.
"""

from __future__ import annotations

import re
import struct
from functools import lru_cache
from itertools import chain, islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import blocks
from .tables import load, texts

BLOCK_BYTES = 1 << 18    # of text encoded at once
MARK = "▁"  # stands for a space in pieces
CACHED_UNITS = 200_000   # distinct units kept in a task's memory; then it starts anew

OUTPUT = T.StructType([
    T.StructField("ids", T.ArrayType(T.IntegerType())),
    T.StructField("piece_start", T.ArrayType(T.IntegerType())),
    T.StructField("piece_stop", T.ArrayType(T.IntegerType())),
    T.StructField("decoded", T.StringType())])


class CharMap:
    """Longest-prefix replacement through the compiled map: a double-array trie, then its strings."""

    def __init__(self, compiled: bytes):
        self.units, self.strings = [], b""
        if compiled:
            size = struct.unpack_from("<I", compiled)[0]
            self.units = struct.unpack_from(f"<{size // 4}I", compiled, 4)
            self.strings = compiled[4 + size:]

    def longest(self, data: bytes, at: int) -> tuple[int, bytes] | None:
        """(length, replacement) of the longest key that starts at ``at``."""
        found, node = None, 0
        node ^= self._offset(self.units[0])
        for i in range(at, len(data)):
            node ^= data[i]
            unit = self.units[node]
            if unit & 0x800000FF != data[i]:
                break
            node ^= self._offset(unit)
            if unit >> 8 & 1:
                value = self.units[node] & 0x7FFFFFFF
                found = i - at + 1, self.strings[value:self.strings.index(b"\0", value)]
        return found

    @staticmethod
    def _offset(unit: int) -> int:
        return unit >> 10 << ((unit & 1 << 9) >> 6)

    def apply(self, text: str) -> tuple[str, np.ndarray]:
        """Normalised text and, for each of its characters and the end, the original byte offset."""
        if not self.units:
            code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
            at = np.zeros(len(code) + 1, np.int64)
            np.cumsum(1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF), out=at[1:])
            return text, at
        data, out, at, i = text.encode("utf-8", "surrogatepass"), [], [], 0
        while i < len(data):
            hit = self.longest(data, i)
            if hit:
                size, new = hit[0], hit[1].decode("utf-8")
            else:
                lead = data[i]
                size = 1 if lead < 0x80 else 2 if lead < 0xE0 else 3 if lead < 0xF0 else 4
                new = data[i:i + size].decode("utf-8", "replace")
            out.append(new)
            at += [i] * len(new)
            i += size
        return "".join(out), np.array([*at, len(data)], np.int64)


class Codec:
    """A model file's encoder and decoder."""

    def __init__(self, model: bytes, bos: bool = False, eos: bool = True):
        import sentencepiece
        from sentencepiece import sentencepiece_model_pb2 as pb

        proto = pb.ModelProto()
        proto.ParseFromString(model)
        spec = proto.normalizer_spec
        self.map = CharMap(spec.precompiled_charsmap)
        self.dummy, self.squeeze = spec.add_dummy_prefix, spec.remove_extra_whitespaces
        self.plain = not self.map.units and not self.squeeze and not proto.trainer_spec.treat_whitespace_as_suffix
        self.mark = MARK if spec.escape_whitespaces else " "
        self.suffix = proto.trainer_spec.treat_whitespace_as_suffix
        self.decoder = sentencepiece.SentencePieceProcessor(model_proto=model)
        self.bos = [self.decoder.bos_id()] if bos else []
        self.eos = [self.decoder.eos_id()] if eos else []
        spec.precompiled_charsmap = b""
        spec.add_dummy_prefix = spec.remove_extra_whitespaces = spec.escape_whitespaces = False
        self.encoder = sentencepiece.SentencePieceProcessor(model_proto=proto.SerializeToString())
        pieces = [p.piece for p in proto.pieces if p.type in (1, 4)]
        # a unit is a run of marks with what follows, or a line break no piece holds
        crossing = any(re.search(f"[^{self.mark}]{self.mark}", p) for p in pieces)
        whole = crossing or self.suffix or proto.trainer_spec.model_type not in (1, 2) or any(p.type == 4 for p in proto.pieces)
        joined = {c for p in pieces if len(p) > 1 for c in p}
        self.alone = "\n" not in joined  # no longer piece holds it
        self.split = not whole
        self.chars = np.array([1 if p.type == 6 else len(p.piece) for p in proto.pieces], np.int64)
        self.byte = np.array([int(p.piece[3:5], 16) if p.type == 6 else -64 for p in proto.pieces], np.int64)
        self.unknown = -1 if proto.trainer_spec.byte_fallback else self.decoder.unk_id()
        self._forget()

    def _forget(self):
        self.known: dict = {}  # hash of a unit -> its number
        self.flat, self.at, self.long = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def normalise(self, text: str) -> tuple[str, np.ndarray]:
        """Text as the model sees it, and the original byte offset of each character and the end."""
        text, at = self.map.apply(text)
        if self.squeeze:
            keep = np.fromiter((c != " " for c in text), bool, len(text))
            keep[1:] |= keep[:-1].copy()
            last = text.rstrip(" ")
            first = len(text) - len(text.lstrip(" "))
            keep[:first], keep[len(last):] = False, False
            text = "".join(c for c, k in zip(text, keep) if k)
            at = np.append(at[:-1][keep], at[len(last)] if len(last) else 0)
        if self.dummy and text:
            text, at = (text + " ", np.append(at, at[-1])) if self.suffix else (" " + text, np.append(at[0], at))
        return text.replace(" ", self.mark), at

    def _units(self, data, offsets):
        """Starts of the units in the normalised bytes of a block."""
        new = np.zeros(len(data), bool)
        new[offsets[:-1][np.diff(offsets) > 0]] = True
        if self.split:
            space = data == 0x20
            new[1:] |= space[1:] & ~space[:-1]
            if self.alone:
                line = data == 0x0A
                new |= line
                new[1:] |= line[:-1]
        return np.flatnonzero(new)

    def _learn(self, keys, strings):
        if len(self.known) > CACHED_UNITS:
            self._forget()
        n, made = len(self.long), self.encoder.encode(strings, num_threads=1)
        long = np.fromiter(map(len, made), np.int64, len(made))
        self.at = np.concatenate([self.at, len(self.flat) + np.cumsum(long) - long])
        self.long = np.concatenate([self.long, long])
        self.flat = np.concatenate([self.flat, np.fromiter(chain.from_iterable(made), np.int32, int(long.sum()))])
        self.known.update(zip(keys, range(n, n + len(keys))))

    def _ids(self, data, offsets):
        """Ids of a block and how many each text has."""
        start = self._units(data, offsets)
        long = np.diff(start, append=len(data))
        key, one, which = np.unique(blocks.run_hashes(data, long), return_index=True, return_inverse=True)
        keys = key.tolist()
        if len(self.known) + len(keys) > 2 * CACHED_UNITS:
            self._forget()
        new = [i for i, k in enumerate(keys) if k not in self.known]
        if new:
            raw, at, n = data.tobytes(), start[one[new]].tolist(), long[one[new]].tolist()
            self._learn([keys[i] for i in new], [raw[a:a + b].decode().replace(" ", self.mark) for a, b in zip(at, n)])
        if len(self.known) < len(keys) or any(k not in self.known for k in keys):
            self._learn(keys, [data[a:a + b].tobytes().decode().replace(" ", self.mark) for a, b in zip(start[one], long[one])])
        number = np.fromiter(map(self.known.__getitem__, keys), np.int64, len(keys))[which]
        count = self.long[number]
        total = np.zeros(len(count) + 1, np.int64)
        np.cumsum(count, out=total[1:])
        return self.flat[blocks.ranges(self.at[number], count)], np.diff(total[np.searchsorted(start, offsets)])

    def _sizes(self, ids, count, texts):
        """Characters of each piece; of a character's byte pieces only the last has it."""
        size = self.chars[ids]
        byte = self.byte[ids]
        size[:-1][(byte[:-1] >= 0) & (byte[1:] & 0xC0 == 0x80)] = 0
        if self.unknown >= 0:  # an unknown piece is a run of any length
            first = np.cumsum(count) - count
            for k in np.unique(np.searchsorted(first, np.flatnonzero(ids == self.unknown), "right") - 1):
                made = self.encoder.encode(texts[k].replace(" ", self.mark), return_type="offset_mapping")
                size[first[k]:first[k] + count[k]] = [b - a for a, b in made["offsets"]]
        return size

    def encode(self, texts: list[str]):
        """Ids, piece starts and stops (original byte offsets) of all texts, and each text's number of pieces."""
        norm, slow, n = [], {}, len(texts)
        for k, text in enumerate(texts):
            if self.plain and MARK not in text:
                norm.append(" " + text if self.dummy and text else text)
            else:
                text, slow[k] = self.normalise(text)
                norm.append(text.replace(self.mark, " "))
        data, offsets = blocks.string_column(pa.array(norm, pa.large_string()))
        ids, count = self._ids(data, offsets) if len(data) else (np.zeros(0, np.int32), np.zeros(n, np.int64))
        char = np.flatnonzero((data & 0xC0) != 0x80)
        first = np.searchsorted(char, offsets)
        doc = np.repeat(np.arange(n), np.diff(first))
        origin = np.maximum(char - offsets[doc] - (1 if self.dummy else 0), 0)
        end = np.maximum(np.diff(offsets) - (1 if self.dummy else 0), 0)
        for k, at in slow.items():
            origin[first[k]:first[k + 1]], end[k] = at[:-1], at[-1]
        size, text = self._sizes(ids, count, norm), np.repeat(np.arange(n), count)
        stop = np.cumsum(size)
        origin = np.append(origin, 0)
        start, stop = origin[stop - size], np.where(stop == first[1:][text], end[text], origin[stop])
        b, extra = len(self.bos), len(self.bos) + len(self.eos)
        if extra:
            place = np.arange(len(ids)) + text * extra + b
            last = np.cumsum(count + extra)
            put = []
            for x, before, after in ((ids, self.bos, self.eos), (start, 0, end[:, None]), (stop, 0, end[:, None])):
                y = np.empty(len(ids) + n * extra, np.int32)
                y[place] = x
                y[(last - count - extra)[:, None] + np.arange(b)] = before
                y[last[:, None] - len(self.eos) + np.arange(len(self.eos))] = after
                put.append(y)
            ids, start, stop = put
        return ids, start, stop, count + extra

    def decode(self, ids: list[list[int]]) -> list[str]:
        return self.decoder.decode(ids) if ids else []


@lru_cache(maxsize=1)
def _codec(model: bytes, bos: bool = False, eos: bool = True) -> Codec:
    """One codec for all tasks of a worker, with the units it has met."""
    return Codec(model, bos, eos)


def _lists(values, lengths):
    offsets = np.zeros(len(lengths) + 1, np.int32)
    np.cumsum(lengths, out=offsets[1:])
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.astype(np.int32)))


def encode(docs: DataFrame, model: bytes, text_col: str = "text", bos: bool = False, eos: bool = True) -> DataFrame:
    """``docs`` with ids, piece_start and piece_stop (original UTF-8 bytes), and the decoded text.

    ``model`` is the content of a model file, sent to the executors once.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept = [f for f in docs.schema.fields if f.name.lower() not in {x.lower() for x in OUTPUT.names}]
    schema = T.StructType([*kept, *OUTPUT.fields])

    def make(batches):
        codec = _codec(shared.value, bos, eos)
        for block in blocks.text_blocks(batches, text_col, BLOCK_BYTES):
            ids, start, stop, long = codec.encode([x or "" for x in block.column(block.schema.get_field_index(text_col)).to_pylist()])
            each = iter(ids.tolist())
            yield pa.RecordBatch.from_arrays(
                [*(block.column(block.schema.get_field_index(f.name)) for f in kept),
                 _lists(ids, long), _lists(start, long), _lists(stop, long),
                 pa.array(codec.decode([list(islice(each, k)) for k in long.tolist()]), pa.string())], schema.names)

    return docs.mapInArrow(make, schema)


def decode(tokens: DataFrame, model: bytes, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """``tokens`` with the text of its ids; null ids are an empty list."""
    shared = tokens.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf(T.StringType())
    def text(ids: pd.Series) -> pd.Series:
        return pd.Series(_codec(shared.value).decode([[] if i is None else [int(j) for j in i] for i in ids]), dtype=object)

    return tokens.withColumn(out_col, text(F.col(ids_col)))


def model_file(name: str = "piece_bpe_32k.model") -> bytes:
    import public_tokenizers
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


def digest_columns():
    return (F.size("ids").cast("long").alias("n_tokens"),
            F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
            F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


def query(spark, sf_dir):
    return encode(texts(load(spark, sf_dir, "documents")), model_file()).select("doc_id", *digest_columns())
