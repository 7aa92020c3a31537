"""Byte-level BPE, encoded with a segment tree over the ranks of adjacent pairs, and decoded.

A piece of text (the tokenizer's pattern splits them off) starts as its bytes. Leaf i of the tree holds the rank of the
pair that starts at symbol i, joined with i, so the root is the leftmost pair of the lowest rank. A merge changes three
leaves, each updated along its path to the root, until the root says that no pair merges. Pieces of like length are
merged together, as rows of numpy arrays; long ones are merged one at a time with the same tree. Pieces already seen
come from a bounded memory in each Python worker.

The vocabulary is read from a tokenizer file of the `tokenizers` library (its path is a parameter, on every machine) and
is never trained. Results equal that library's encode(add_special_tokens=False) and decode(skip_special_tokens=False):
the text of a special token becomes that token.

Defined results: null text is empty text and has no ids; texts of any length are encoded whole; equal texts have equal
ids; rows are neither merged nor dropped; a null id stays null; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from loomwright.llm.common import arrow_batched, beside, only, table, texts_of

#: The pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that a worker remembers and their characters, leaves above which pieces are merged singly (with the same
#: result), characters encoded at once.
CACHE_PIECES, CACHE_CHARS, WIDE, CHUNK_CHARS = 500_000, 8_000_000, 256, 500_000
NONE = np.int64(2**62)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_alphabet() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, byte = spec["model"], byte_alphabet()
        raw = lambda token: bytes(byte[c] for c in token)
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.token_bytes: list[bytes] = [b""] * size
        for token, i in model["vocab"].items():
            self.token_bytes[i] = token.encode() if token in self.special else raw(token)
        for token, i in self.special.items():
            self.token_bytes[i] = token.encode()
        self.byte_id = np.zeros(256, np.int64)
        for c, b in byte.items():
            self.byte_id[b] = model["vocab"][c]
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        key = np.array([model["vocab"][a] * 2**20 + model["vocab"][b] for a, b in pairs], np.int64)
        self.made = np.array([model["vocab"][a + b] for a, b in pairs], np.int64)
        first = dict(zip(key[::-1].tolist(), range(len(key) - 1, -1, -1), strict=True))
        self.rank_of = first
        self.keys = np.array(sorted(first), np.int64)
        self.ranks = np.array([first[k] for k in self.keys.tolist()], np.int64)
        self.split = regex.compile("|".join(map(regex.escape, self.special)) or r"(?!)")
        self.pattern = regex.compile(PATTERN)
        self.memory: dict[str | int, bytes] = {}
        self.held = 0

    def pair_ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left * 2**20 + right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge_rows(self, pieces: list[bytes], width: int) -> list[np.ndarray]:
        """Pieces of 2 to width + 1 bytes, merged side by side; width is a power of two."""
        n, size = len(pieces), np.fromiter(map(len, pieces), np.int64, len(pieces))
        cols = width + 2  # column `size` is the end, and never merged
        flat = self.byte_id[np.frombuffer(b"".join(pieces), np.uint8)]
        where = np.arange(cols) < size[:, None]
        sym = np.full((n, cols), -1, np.int64)
        sym[where] = flat
        nxt = np.tile(np.arange(1, cols + 1), (n, 1))
        prv = np.tile(np.arange(-1, cols - 1), (n, 1))
        alive = where.copy()
        tree = np.full((n, 2 * width), NONE, np.int64)
        a, b = sym[:, :width], sym[:, 1 : width + 1]
        rank = np.where(b >= 0, self.pair_ranks(np.maximum(a, 0), np.maximum(b, 0)), NONE)
        tree[:, width:] = np.where(rank < NONE, rank * width + np.arange(width), NONE)
        level = width
        while level > 1:
            tree[:, level // 2 : level] = np.minimum(tree[:, level : 2 * level : 2], tree[:, level + 1 : 2 * level : 2])
            level //= 2
        row = np.flatnonzero(tree[:, 1] < NONE)
        while len(row):
            root = tree[row, 1]
            at, made = root % width, self.made[root // width]
            gone = nxt[row, at]
            after = nxt[row, gone]
            sym[row, at], alive[row, gone], nxt[row, at] = made, False, after
            prv[row, np.minimum(after, cols - 1)] = at
            right = sym[row, np.minimum(after, cols - 1)]
            new = np.where(right >= 0, self.pair_ranks(made, np.maximum(right, 0)), NONE)
            before = prv[row, at]
            left = sym[row, np.maximum(before, 0)]
            old = np.where(before >= 0, self.pair_ranks(left, made), NONE)
            tree[row, width + np.minimum(gone, width - 1)] = np.where(gone < width, NONE, tree[row, 2 * width - 1])
            tree[row, width + at] = np.where(new < NONE, new * width + at, NONE)
            was = tree[row, width + np.maximum(before, 0)]
            tree[row, width + np.maximum(before, 0)] = np.where(before >= 0, np.where(old < NONE, old * width + before, NONE), was)
            nodes = [width + at, width + np.minimum(gone, width - 1), width + np.maximum(before, 0)]
            for _ in range(width.bit_length() - 1):
                nodes = [x >> 1 for x in nodes]
                for x in nodes:
                    tree[row, x] = np.minimum(tree[row, 2 * x], tree[row, 2 * x + 1])
            row = row[tree[row, 1] < NONE]
        ids = sym[alive].astype("<u4")
        return np.split(ids, np.cumsum(alive.sum(1))[:-1])

    def merge_one(self, piece: bytes) -> np.ndarray:
        """The same tree for one long piece, in plain lists."""
        sym = self.byte_id[np.frombuffer(piece, np.uint8)].tolist()
        n, width = len(sym), 1
        while width < n:
            width *= 2
        nxt, prv, rank_of, none = list(range(1, n + 1)), list(range(-1, n - 1)), self.rank_of, (int(NONE), 0)
        tree = [none] * (2 * width)
        made = self.made

        def put(i: int, rank: int | None) -> None:
            k = width + i
            tree[k] = none if rank is None else (rank, i)
            k >>= 1
            while k:
                low = min(tree[2 * k], tree[2 * k + 1])
                if tree[k] == low:
                    break
                tree[k] = low
                k >>= 1

        for i in range(n - 1):
            r = rank_of.get(sym[i] * 2**20 + sym[i + 1])
            if r is not None:
                tree[width + i] = (r, i)
        for k in range(width - 1, 0, -1):
            tree[k] = min(tree[2 * k], tree[2 * k + 1])
        while tree[1] is not none and tree[1][0] < none[0]:
            rank, i = tree[1]
            j = nxt[i]
            k, p = nxt[j], prv[i]
            sym[i], sym[j], nxt[i] = int(made[rank]), -1, k
            put(j, None)
            if k < n:
                prv[k] = i
            put(i, rank_of.get(sym[i] * 2**20 + sym[k]) if k < n else None)
            if p >= 0:
                put(p, rank_of.get(sym[p] * 2**20 + sym[i]))
        return np.array([s for s in sym if s >= 0], "<u4")

    def merge_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of each piece, as little-endian unsigned 32-bit integers."""
        out: list[bytes] = [b""] * len(pieces)
        by_width: dict[int, list[int]] = {}
        for i, p in enumerate(pieces):
            if len(p) < 2:
                out[i] = self.byte_id[np.frombuffer(p, np.uint8)].astype("<u4").tobytes()
            elif len(p) - 1 > WIDE:
                out[i] = self.merge_one(p).tobytes()
            else:
                by_width.setdefault(1 << (len(p) - 2).bit_length(), []).append(i)
        for width, which in by_width.items():
            step = max(1, 400_000 // width)
            for k in range(0, len(which), step):
                part = which[k : k + step]
                for i, ids in zip(part, self.merge_rows([pieces[i] for i in part], width), strict=True):
                    out[i] = ids.tobytes()
        return out

    def parts(self, text: str) -> list[str | int]:
        """Pieces of the text, and ids where it has special tokens."""
        found = self.pattern.findall
        if not any(s in text for s in self.special):
            return found(text)
        out, at = [], 0
        for m in self.split.finditer(text):
            out += [*found(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + found(text[at:])

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [self.parts(t) for t in texts]
        if len(self.memory) > CACHE_PIECES or self.held > CACHE_CHARS:
            self.memory.clear()
            self.held = 0
        new = [p for p in set().union(*parts).difference(self.memory)] if parts else []
        words = [p for p in new if isinstance(p, str)]
        self.held += sum(map(len, words))
        self.memory.update(zip(words, self.merge_all([p.encode("utf-8", "surrogatepass") for p in words]), strict=True))
        self.memory.update((p, np.array([p], "<u4").tobytes()) for p in new if not isinstance(p, str))
        get = self.memory.__getitem__
        return [b"".join(map(get, p)) for p in parts]

    def decode(self, ids: bytes) -> str:
        get = self.token_bytes.__getitem__
        return b"".join(map(get, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(4)
def bpe(path: str) -> Bpe:
    return Bpe(path)


def chunks(texts: list[str], most: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of texts that hold about so many characters."""
    start = held = 0
    for i, t in enumerate(texts):
        held += len(t)
        if held >= most:
            yield start, i + 1
            start, held = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def encode_frame(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The id column, and ids: the token ids of each whole text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b, text_col)
            for i, j in chunks(texts):
                ids = [np.frombuffer(x, "<u4").astype(np.int32) for x in bpe(path).encode(texts[i:j])]
                yield beside(b.column(id_col).slice(i, j - i), {"ids": pa.array(ids, pa.list_(pa.int32()))}, id_col)

    src = only(df, [id_col, text_col])
    return arrow_batched(src, run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, ids array<int>")


def decode_frame(df: DataFrame, path: str | None = None, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """The id column, and text: what the ids spell; bytes that are no UTF-8 become U+FFFD."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = [bpe(path).decode(np.asarray([] if x is None else x, "<u4").tobytes()) for x in b.column(ids_col).to_pylist()]
            yield beside(b.column(id_col), {"text": pa.array(texts, pa.string())}, id_col)

    src = only(df, [id_col, ids_col])
    return arrow_batched(src, run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, text string")


def round_trip_digests(df: DataFrame, path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each row: the number of tokens, and digests of the ids and of the text decoded from them."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = texts_of(b, text_col)
            for i, j in chunks(texts):
                ids = bpe(path).encode(texts[i:j])
                made = {
                    "n_tokens": np.array([len(x) // 4 for x in ids], np.int64),
                    "ids_sha256": [hashlib.sha256(x).hexdigest() for x in ids],
                    "decoded_sha256": [hashlib.sha256(bpe(path).decode(x).encode()).hexdigest() for x in ids],
                }
                yield beside(b.column(id_col).slice(i, j - i), made, id_col)

    src = only(df, [id_col, text_col])
    return arrow_batched(src, run, f"`{id_col}` {src.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_segment_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip_digests(table(spark, sf_dir, "documents"))
