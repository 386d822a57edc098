"""SentencePiece BPE encoding that keeps offsets, and decoding.

The text is normalised by the longest prefix that the model's compiled character map knows, and each byte of
the result remembers the byte of the text that it came from. Pieces are found on the normalised text
and projected through that alignment to byte spans of the text.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Sequence
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import in_arrow, with_arrow

SPACE = "▁"
#: Fixed values of the model format: piece types.
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Encoded chunks that a task remembers, of up to so many characters each (some 15 MB), and as many of the ones before them; what is used again stays.
REMEMBERED, REMEMBERED_CHARS = 70_000, 48

codecs.register_error("glintspan_bytewise", lambda e: ("�", e.start + 1))


class CharacterMap:
    """The compiled map of a model: a double-array trie of byte strings, and their replacements."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist()
        self.replacements = blob[4 + size :]
        self.known: dict[bytes, tuple[int, bytes] | None] = {}

    def longest(self, raw: bytes, at: int) -> tuple[int, bytes] | None:
        """Length of the longest known prefix of raw[at:], and its replacement."""
        units, node, found = self.units, 0, None
        node ^= (units[0] >> 10) << ((units[0] & 512) >> 6)
        for i in range(at, len(raw)):
            node ^= raw[i]
            if node >= len(units) or units[node] & 0x800000FF != raw[i]:
                break
            unit = units[node]
            node ^= (unit >> 10) << ((unit & 512) >> 6)
            if unit >> 8 & 1:
                found = (i + 1 - at, units[node] & 0x7FFFFFFF)
        if found is None:
            return None
        return found[0], self.replacements[found[1] : self.replacements.index(b"\0", found[1])]


class Codec:
    """One model. encode(text) gives ids and spans, decode(ids) a text."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        model = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            model.ParseFromString(f.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        kinds = [p.type for p in model.pieces]
        if train.model_type != train.BPE or train.treat_whitespace_as_suffix or USER_DEFINED in kinds or UNUSED in kinds:
            raise ValueError("only BPE models without user-defined or unused pieces and with leading spaces are supported")
        self.map = CharacterMap(norm.precompiled_charsmap) if norm.precompiled_charsmap else None
        self.dummy, self.squeeze, self.escape = norm.add_dummy_prefix, norm.remove_extra_whitespaces, norm.escape_whitespaces
        self.bos, self.eos, self.unk = train.bos_id, train.eos_id, kinds.index(UNKNOWN)
        self.pieces = [p.piece for p in model.pieces]
        self.score = {p.piece: p.score for p in model.pieces if p.type == NORMAL}
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type == NORMAL}
        self.bytes = {int(p.piece[1:-1], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE} if train.byte_fallback else None
        self.surface = [b"" if k == CONTROL else train.unk_surface.encode() if k == UNKNOWN else bytes([int(p[1:-1], 16)]) if k == BYTE else p.replace(SPACE, " ").encode() for p, k in zip(self.pieces, kinds, strict=True)]
        self.leads = [k == NORMAL and p.startswith(SPACE) for p, k in zip(self.pieces, kinds, strict=True)]
        self.control = [k == CONTROL for k in kinds]
        self.length = np.array([0 if k == CONTROL else 1 if k == BYTE else len(p.encode()) for p, k in zip(self.pieces, kinds, strict=True)], np.int64)
        # Chunks that no piece can join to what follows are encoded, and remembered, by themselves: spaces and
        # a run of characters of one group. Groups are the characters that pieces hold side by side.
        group: dict[str, str] = {}

        def root(x: str) -> str:
            while group.setdefault(x, x) != x:
                group[x] = group[group[x]]
                x = group[x]
            return x

        spaced = any(SPACE in p.lstrip(SPACE) for p in self.score)
        for p in self.score:
            p = p if spaced else p.lstrip(SPACE)
            for a, b in zip(p, p[1:]):
                group[root(a)] = root(b)
        members: dict[str, list[str]] = {}
        for x in list(group):
            members.setdefault(root(x), []).append(x)
        any_of = "|".join(f"[{''.join(map(re.escape, sorted(m)))}]+" for m in sorted(members.values(), key=len, reverse=True))
        any_of = f"{any_of}|." if any_of else "."
        self.chunks = re.compile(any_of if spaced else f"{SPACE}*(?:{any_of})|{SPACE}+", re.S)
        self.cache: dict[str, bytes] = {}
        self.before: dict[str, bytes] = {}

    def normalize(self, raw: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each, and for the end, the byte of `raw` that it starts from."""
        if self.map is None and not self.squeeze:
            space = np.frombuffer(raw, np.uint8) == 32
            wide = 3 if self.escape else 1
            lead = SPACE.encode() if self.escape else b" "
            out = (lead if self.dummy and raw else b"") + (raw.replace(b" ", lead))
            align = np.repeat(np.arange(len(raw)), np.where(space, wide, 1))
            return out, np.concatenate([np.zeros(len(out) - len(align), np.int64), align, [len(raw)]])
        parts: list[tuple[int, int, bytes]] = []  # begin and end in raw, replacement
        at = 0
        while at < len(raw):
            hit = self.map.longest(raw, at) if self.map else None
            size = hit[0] if hit else next((n for n in range(1, 5) if at + n >= len(raw) or raw[at + n] & 0xC0 != 0x80), 4)
            parts.append((at, at + size, hit[1] if hit else raw[at : at + size]))
            at += size
        if self.squeeze:
            while parts and parts[0][2] == b" ":
                parts.pop(0)
        out, align, lead = bytearray(), [], SPACE.encode() if self.escape else b" "
        if parts and self.dummy:
            out += lead
            align += [parts[0][0]] * len(lead)
        blank, end = self.squeeze, parts[0][0] if parts else 0
        for begin, stop, text in parts:
            if blank:
                text = text.lstrip(b" ")
            if text:
                new = text.replace(b" ", lead)
                out += new
                align += [begin] * len(new)
                blank = self.squeeze and text.endswith(b" ")
            end = stop
        if self.squeeze:
            while out.endswith(lead):
                del out[-len(lead) :]
                end = align[len(out)]
                del align[len(out) :]
        return bytes(out), np.array([*align, end], np.int64)

    def _merge(self, chunk: str) -> list[str]:
        """Pieces of a chunk: the best scored neighbours join until none do; among equals the leftmost."""
        parts: list[str | None] = list(chunk)
        n, score = len(parts), self.score
        if n <= REMEMBERED_CHARS:
            get, none = score.get, float("-inf")
            pairs = [get(a + b, none) for a, b in zip(parts, parts[1:])]
            while pairs and (best := max(pairs)) != none:
                i = pairs.index(best)
                parts[i : i + 2] = [parts[i] + parts[i + 1]]
                del pairs[i]
                if i:
                    pairs[i - 1] = get(parts[i - 1] + parts[i], none)
                if i < len(pairs):
                    pairs[i] = get(parts[i] + parts[i + 1], none)
            return parts
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[float, int, str]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and (s := score.get(t := parts[i] + parts[j])) is not None:
                heapq.heappush(heap, (-s, i, t))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, t = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= n or parts[i] + parts[j] != t:
                continue
            parts[i], parts[j], after[i] = t, None, after[j]
            if after[i] < n:
                before[after[i]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [p for p in parts if p is not None]

    def forget(self) -> None:
        self.cache, self.before = {}, {}

    def _chunk(self, chunk: str) -> bytes:
        if (known := self.before.get(chunk)) is None:
            known = self._encoded(chunk)
        if len(chunk) <= REMEMBERED_CHARS:
            if len(self.cache) >= REMEMBERED:
                self.cache, self.before = {}, self.cache
            self.cache[chunk] = known
        return known

    def _encoded(self, chunk: str) -> bytes:
        ids: list[int] = []
        for p in self._merge(chunk):
            if (i := self.ids.get(p)) is not None:
                ids.append(i)
            elif self.bytes is not None:
                ids += [self.bytes[b] for b in p.encode()]
            else:
                ids.append(self.unk)
        return np.array(ids, "<u4").tobytes()

    def _ids(self, normal: bytes) -> np.ndarray:
        make = self._chunk
        return np.frombuffer(b"".join([self.cache.get(c) or make(c) for c in self.chunks.findall(normal.decode("utf-8", "glintspan_bytewise"))]), "<u4")

    def encode(self, text: str | bytes, ends: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """ids, and the byte in the text at which each id's span begins and ends; the begin and end ids have empty spans."""
        raw = text.encode() if isinstance(text, str) else text
        normal, align = self.normalize(raw)
        ids = self._ids(normal)
        size = self.length[ids]
        if self.bytes is None and (ids == self.unk).any():  # unknown neighbours are one piece, as long as its characters
            parts = [p for c in self.chunks.findall(normal.decode()) for p in self._merge(c)]
            size = np.array([len(p.encode()) for p in parts], np.int64)
            keep = np.ones(len(ids), bool)
            keep[1:] = (ids[1:] != self.unk) | (ids[:-1] != self.unk)
            size, ids = np.add.reduceat(size, np.flatnonzero(keep)), ids[keep]
        stop = np.cumsum(size)
        begin, stop = align[stop - size], align[stop]
        if ends:
            ids = np.concatenate([np.array([self.bos], "<u4"), ids, np.array([self.eos], "<u4")])
            begin, stop = np.concatenate([[0], begin, [len(raw)]]), np.concatenate([[0], stop, [len(raw)]])
        return ids, begin, stop

    def decode(self, ids: Sequence[int]) -> str:
        """The text of ids: byte pieces join to characters, bytes of no character are U+FFFD, one leading space is dropped."""
        ids = ids.tolist() if isinstance(ids, np.ndarray) else list(ids)
        out = b"".join(map(self.surface.__getitem__, ids))
        if self.dummy or self.squeeze:
            first = next((i for i in ids if not self.control[i]), None)
            if first is not None and self.leads[first]:
                out = out.lstrip(b" ") if self.squeeze else out[1:]
        return out.decode("utf-8", "glintspan_bytewise")


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


#: What encode_documents can return for a text.
OUTPUTS = {"n_tokens": "long", "ids": "array<int>", "begins": "array<long>", "ends": "array<long>", "decoded": "string", "ids_sha256": "string", "decoded_sha256": "string", "spanned_bytes": "long"}


def encode_documents(docs: DataFrame, model: str, *, text_col: str = "text", outputs: Sequence[str] = ("n_tokens", "ids", "begins", "ends", "decoded"), keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """The columns `keep` of each row, and of its whole text what `outputs` names (see OUTPUTS).

    ids: with begin and end ids. begins, ends: the byte span of each id in the text's UTF-8. decoded: the
    text that the ids decode to. The digests are SHA-256 in lowercase hex, of the ids as little-endian
    unsigned 32-bit integers and of the decoded text. spanned_bytes: bytes that the spans cover. A null text is as
    an empty one: begin and end ids only. Each row gives one row, in no order. `model` is a path that every
    executor can open.
    """
    kept = [F.col(c).alias(f"k{i}") for i, c in enumerate(keep)]
    rows = docs.select(*kept, F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    kinds = dict(rows.dtypes)
    outputs = list(outputs)

    def one(text: str, c: Codec) -> list:
        ids, begin, end = c.encode(text)
        decoded = c.decode(ids) if any(o.startswith("decoded") for o in outputs) else None
        make = {
            "n_tokens": lambda: len(ids), "ids": lambda: ids.astype(np.int32), "begins": lambda: begin, "ends": lambda: end, "decoded": lambda: decoded,
            "ids_sha256": lambda: hashlib.sha256(ids.tobytes()).hexdigest(), "decoded_sha256": lambda: hashlib.sha256(decoded.encode()).hexdigest(),
            "spanned_bytes": lambda: int((end - begin).sum()),
        }
        return [make[o]() for o in outputs]

    types = {"long": pa.int64(), "string": pa.string(), "array<int>": pa.list_(pa.int32()), "array<long>": pa.list_(pa.int64())}
    names = [f"k{i}" for i in range(len(keep))]

    def run(it):
        c = codec(model)
        for batch in it:
            texts = batch.column("text")
            lo = 0
            while lo < len(texts):  # texts of about 1 MB at a time
                hi, size = lo, 0
                out: list[list] = []
                while hi < len(texts) and size < 1_000_000:
                    text = texts[hi].as_py()
                    out.append(one(text, c))
                    size, hi = size + len(text), hi + 1
                columns = [pa.array(x, types[OUTPUTS[o]]) for o, x in zip(outputs, zip(*out, strict=True), strict=True)]
                yield pa.RecordBatch.from_arrays([*(batch.column(n).slice(lo, hi - lo) for n in names), *columns], names=[*names, *outputs])
                lo = hi
        c.forget()

    schema = ", ".join([*(f"{n} {kinds[n]}" for n in names), *(f"{o} {OUTPUTS[o]}" for o in outputs)])
    return in_arrow(rows, run, schema).select(*[F.col(n).alias(c) for n, c in zip(names, keep, strict=True)], *outputs)


def decode_column(df: DataFrame, model: str, ids_col: str, out_col: str) -> DataFrame:
    """`df` with `out_col`: the text of the ids in `ids_col`. Null ids give null, no ids an empty text. Each row gives one row; a column named `out_col` is replaced, others stay. No rows in, none out."""
    return with_arrow(df, lambda batch: [pa.array([None if x is None else codec(model).decode(x) for x in batch.column("r0").to_pylist()], pa.string())], [F.col(ids_col)], f"`{out_col}` string")
