"""BPE encoding and decoding with content-defined chunk reuse.

1. A gear hash cuts every text into content-defined chunks. Chunk digests are counted over all
   documents (digests and lengths are shuffled, not texts).
2. The chunks whose reuse saves most bytes are the shared chunks: at most ``SHARED_CHUNKS``, of at
   most ``MOST`` bytes each, so the table of them has a proven bound (below 64 MB of
   chunk bytes and ids at the defaults) and is broadcast. Each is encoded once, by the tasks. Chunks beyond that table are
   encoded in their documents, so the bound never changes a result.
3. A document takes the ids of its shared chunks and encodes the rest. Where the two meet, ids of a
   chunk alone can differ from ids in the text. The join is repaired: the text around it is encoded
   again, from a white-space edge inside one chunk to one inside the other, with a word of overlap
   on both sides. If the overlaps agree with the chunks' own ids, the outer ids stand, since no
   token and no pre-token spans such an edge; if not, the neighbouring chunk is given up and the
   stretch encoded anew, at the utmost the whole document.

Encoding uses the vocabulary of a byte-level BPE ``tokenizer.json`` (path as parameter) through
tiktoken's merge loop; decoding joins the bytes of the ids and reads them as UTF-8.

Edge cases: null text counts as empty, which has no ids; text of the end marker is its special id;
very long texts and texts without white space are encoded whole; a digest is trusted only if the
bytes agree; repeated rows are encoded each; an empty table gives an empty result; columns beyond id
and text are not read. A text is held whole by one task.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from functools import lru_cache
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytehash import Spans, gear
from .common import documents, row_slices, small_batches, text_buffer, without
from .registry import register

SHARED_CHUNKS = 16_384
SLICE_ROWS = 512
LEAST, MOST = 128, 1024
CUT = np.uint32(0xFF << 20)  # one cut in 256 bytes beyond LEAST
# Fixed value: the pre-token pattern of byte-level BPE.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

# White space of that pattern, in runs that its look-ahead would remember character by character.
LONG_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{10000,}")


def default_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves,
    the others, in order, for the letters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _vocabulary(path: str) -> tuple[dict[bytes, int], dict[str, int]]:
    """Ranks of the byte strings and ids of the special tokens of a ``tokenizer.json``."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    letters = _byte_letters()
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {bytes(letters[c] for c in word): i for word, i in spec["model"]["vocab"].items()
            if word not in special}, special


class Codec:
    """Encoder of one vocabulary file."""

    def __init__(self, path: str):
        import tiktoken
        ranks, special = _vocabulary(path)
        self._tiktoken = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)
        self._special = tuple(special)

    def ids(self, text: bytes) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers.

        A long run of white space is cut out and merged as the one pre-token that it is: all of the run, but
        for its last character if a text follows that is not white space or a special token."""
        s, out, done = text.decode(), [], 0
        for m in LONG_RUN.finditer(s):
            end = m.end() - (m.end() < len(s) and not s.startswith(self._special, m.end()))
            out += self._tiktoken.encode(s[done:m.start()], allowed_special="all")
            out += self._tiktoken._encode_single_piece(s[m.start():end])
            done = end
        return np.array(out + self._tiktoken.encode(s[done:], allowed_special="all"), "<u4").tobytes()


@lru_cache(maxsize=2)
def codec(path: str) -> Codec:
    return Codec(path)


@lru_cache(maxsize=2)
def token_bytes(path: str) -> list[bytes]:
    """The bytes of each id."""
    ranks, special = _vocabulary(path)
    out = [b""] * (max([*ranks.values(), *special.values()]) + 1)
    for word, i in [*ranks.items(), *((w.encode(), i) for w, i in special.items())]:
        out[i] = word
    return out


def chunk_ends(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of all chunks and the index of each row's first chunk (rows + 1 numbers)."""
    cut = np.flatnonzero((gear(data) & CUT) == 0) + 1
    ends: list[int] = []
    first = [0]
    at = off.tolist()
    for start, end in zip(at, at[1:]):
        for c in cut[np.searchsorted(cut, start + LEAST):np.searchsorted(cut, end)].tolist() + [end]:
            while c - start > MOST:
                start += MOST
                ends.append(start)
            if c - start >= LEAST or (c == end and c > start):
                start = c
                ends.append(c)
        first.append(len(ends))
    return np.asarray(ends, np.int64), np.asarray(first, np.int64)


def chunks(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digest, start and end of all chunks, and the index of each row's first chunk."""
    ends, first = chunk_ends(data, off)
    starts = np.zeros_like(ends)
    starts[1:] = ends[:-1]
    filled = first[:-1] < first[1:]
    starts[first[:-1][filled]] = off[:-1][filled]
    digest = Spans(data).digest(starts, ends).view(np.int64) if len(ends) else ends
    return digest, starts, ends, first


def edges(chunk: bytes) -> np.ndarray:
    """Places where a blank follows a printable ASCII byte: always ends of a token and a pre-token."""
    b = np.frombuffer(chunk, np.uint8)
    return np.flatnonzero((b[:-1] > 32) & (b[:-1] < 127) & ((b[1:] == 32) | (b[1:] == 10))) + 1


class Shared(NamedTuple):
    """An encoded chunk: its bytes, the ids between its first and last edge, and its two end words."""

    chunk: bytes
    start: int
    end: int
    ids: bytes
    head: int
    head_ids: bytes
    tail: int
    tail_ids: bytes


def encode_chunk(chunk: bytes, codec: Codec) -> Shared | None:
    """None if the chunk has too few edges to be of use."""
    at = edges(chunk).tolist()
    if len(at) < 4:
        return None
    start, head, tail, end = at[0], at[1], at[-2], at[-1]
    return Shared(chunk, start, end, codec.ids(chunk[start:end]), head, codec.ids(chunk[start:head]),
                  tail, codec.ids(chunk[tail:end]))


def assemble(text: bytes, found: list[tuple[int, Shared]], codec: Codec) -> bytes:
    """Ids of ``text``, of which ``found`` are shared chunks and the places where they begin."""
    out: list[bytes] = []
    done, last = 0, None   # text up to ``done`` is in ``out``; it ends with the inner part of ``last``
    back = []              # the states before each chunk was taken: (done, last, length of out)

    def stretch(end: int) -> bytes:
        """Ids of the text from ``done`` to ``end``; chunks whose last word comes out differently are given up."""
        nonlocal done, last
        while last:
            ids = codec.ids(text[done - (last.end - last.tail):end])
            if ids.startswith(last.tail_ids):
                return ids[len(last.tail_ids):]
            done, last, size = back.pop()
            del out[size:]
        return codec.ids(text[done:end])

    for at, x in found:
        ids = stretch(at + x.head)
        if not ids.endswith(x.head_ids):
            continue  # the chunk's ids do not stand here; its text goes to the next stretch
        back.append((done, last, len(out)))
        out += [ids[:len(ids) - len(x.head_ids)], x.ids]
        done, last = at + x.end, x
    rest = stretch(len(text))
    return b"".join([*out, rest])


def _slices(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray, pa.RecordBatch]]:
    """Bytes, offsets and rows of small parts of the batch."""
    data, off = text_buffer(batch.column(column))
    for i, j in row_slices(off, rows=SLICE_ROWS):
        yield data[off[i]:off[j]], off[i:j + 1] - off[i], batch.slice(i, j - i)


def shared_digests(df: DataFrame, text_col: str = "text", most: int = SHARED_CHUNKS) -> list[int]:
    """Digests of the chunks whose reuse saves most bytes (at most ``most``)."""
    def count(batches):
        for batch in batches:
            for data, off, _ in _slices(batch, 0):
                digest, start, end, _ = chunks(data, off)
                if len(digest):
                    each, at, n = np.unique(digest, return_index=True, return_counts=True)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(each), pa.array((end - start)[at]), pa.array(n)], ["digest", "size", "n"])
    counted = df.select(text_col).mapInArrow(count, "digest bigint, size bigint, n bigint")
    total = counted.groupBy("digest").agg(F.max("size").alias("size"), F.sum("n").alias("n")).filter("n > 1")
    best = total.orderBy(F.desc(F.expr("(n - 1) * size")), "digest").limit(most)
    return [r[0] for r in best.select("digest").collect()]


def shared_chunks(df: DataFrame, digests: list[int], path: str, text_col: str = "text") -> dict[int, tuple]:
    """The given chunks, each encoded once: a task gives a chunk once, the shuffle keeps one of each."""
    if not digests:
        return {}
    wanted = df.sparkSession.sparkContext.broadcast(np.sort(np.array(digests, np.int64)))

    def fetch(batches):
        known, given = wanted.value, set()
        for batch in batches:
            for data, off, _ in _slices(batch, 0):
                digest, start, end, _ = chunks(data, off)
                at = np.minimum(np.searchsorted(known, digest), len(known) - 1)
                fresh = {int(digest[i]): i for i in np.flatnonzero(known[at] == digest).tolist()
                         if int(digest[i]) not in given}
                if fresh:
                    given.update(fresh)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(list(fresh), pa.int64()),
                         pa.array([data[start[i]:end[i]].tobytes() for i in fresh.values()], pa.binary())],
                        ["digest", "chunk"])

    def encode_each(batches):
        for batch in batches:
            each = [(d, encode_chunk(x, codec(path))) for d, x in zip(*(c.to_pylist() for c in batch.columns))]
            each = [(d, x) for d, x in each if x]
            yield pa.RecordBatch.from_pylist([{"digest": d} | x._asdict() for d, x in each], schema=schema)
    schema = pa.schema([("digest", pa.int64()), ("chunk", pa.binary()), ("start", pa.int32()), ("end", pa.int32()),
                        ("ids", pa.binary()), ("head", pa.int32()), ("head_ids", pa.binary()),
                        ("tail", pa.int32()), ("tail_ids", pa.binary())])
    one = df.select(text_col).mapInArrow(fetch, "digest bigint, chunk binary").dropDuplicates(["digest"])
    rows = one.mapInArrow(encode_each, "digest bigint, chunk binary, start int, end int, ids binary, "
                                       "head int, head_ids binary, tail int, tail_ids binary")
    return {r[0]: tuple(bytes(x) if isinstance(x, bytearray) else x for x in r[1:]) for r in rows.collect()}


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str | None = None,
           most: int = SHARED_CHUNKS) -> DataFrame:
    """``id, n_tokens, ids``; ``ids`` are little-endian unsigned 32-bit numbers in one binary."""
    small_batches(df.sparkSession)
    path = vocabulary or default_vocabulary()
    kind = df.schema[id_col].dataType.simpleString()
    table = df.sparkSession.sparkContext.broadcast(
        shared_chunks(df, shared_digests(df, text_col, most), path, text_col))

    def run(batches):
        c, shared = codec(path), table.value
        known = np.sort(np.fromiter(shared, np.int64, len(shared)))
        for batch in batches:
            for data, off, rows in _slices(batch, 1):
                digest, start, _, first = chunks(data, off)
                hit = np.zeros(len(digest), bool)
                if len(known):
                    hit = known[np.minimum(np.searchsorted(known, digest), len(known) - 1)] == digest
                out = []
                for i, (a, b) in enumerate(zip(off.tolist(), off[1:].tolist())):
                    text = data[a:b].tobytes()
                    at = (first[i] + np.flatnonzero(hit[first[i]:first[i + 1]])).tolist()
                    use = [(int(start[j]) - a, Shared(*shared[int(digest[j])])) for j in at]
                    out.append(assemble(text, [(s, x) for s, x in use if text.startswith(x.chunk, s)], c))
                yield pa.RecordBatch.from_arrays(
                    [rows.column(0), pa.array([len(x) // 4 for x in out], pa.int64()), pa.array(out, pa.binary())],
                    ["id", "n_tokens", "ids"])
    return (df.select(id_col, text_col).mapInArrow(run, f"id {kind}, n_tokens bigint, ids binary")
            .withColumnRenamed("id", id_col))


def decode(df: DataFrame, ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """``df`` with ``text``, read from ``ids``."""
    path = vocabulary or default_vocabulary()
    df = without(df, "text")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields)
    at = df.columns.index(ids_col)

    def run(batches):
        known = token_bytes(path)
        for batch in batches:
            for i in range(0, batch.num_rows, SLICE_ROWS):
                rows = batch.slice(i, SLICE_ROWS)
                texts = [b"".join([known[t] for t in np.frombuffer(x.as_buffer(), "<u4").tolist()])
                         .decode("utf-8", errors="replace") if x.is_valid else "" for x in rows.column(at)]
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(texts, pa.string())],
                                                 [*rows.schema.names, "text"])
    return df.mapInArrow(run, f"{schema}, text string")


def round_trip(df: DataFrame, id_col: str = "doc_id", text_col: str = "text",
               vocabulary: str | None = None) -> DataFrame:
    """``id, n_tokens, ids, ids_sha256, decoded_sha256`` of every row, through ``encode`` and ``decode``."""
    d = decode(encode(df, id_col, text_col, vocabulary), vocabulary=vocabulary)
    return d.select(id_col, "n_tokens", "ids", F.sha2("ids", 256).alias("ids_sha256"),
                    F.sha2("text", 256).alias("decoded_sha256"))


@register("op2_bpe_codec")
def op2_bpe_codec(spark, sf_dir):
    return round_trip(documents(spark, sf_dir)).drop("ids")
