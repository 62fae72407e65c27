"""Encoding texts with a public byte-level vocabulary, as a reduction over a tree of pieces.

A text is halved down to leaves, the leaves are encoded, and neighbours are joined up the tree. Encodings of pieces
with that join form a monoid: the join only re-encodes a window around the seam. Why tokens outside the window are
those of the whole text: the vocabulary's pattern cuts a text from left to right into words that are encoded
one by one, so (1) a word of the left piece whose end was decided by characters inside the piece stays a
word, and (2) from any word start that the window's words and the right piece's words have in common, the right
piece's words stand, as they depend on what follows only. The window starts at the last place of kind (1) and grows,
doubling, until it meets a place of kind (2).

Each text is one row and one tree, so there is no shuffle. The trees of a batch of rows are reduced together: all leaves are
encoded in one call, then all windows of each height of the trees. Leaves are shorter than most texts, so that the
ids of the corpus come up the trees; a longer leaf gives the same ids.
"""

from __future__ import annotations

import bisect
import functools
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEAF = 128
#: Characters of the longest fixed word that begins with an apostrophe.
CONTRACTION = 3


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@functools.lru_cache(maxsize=4)
def tokenizer(path: str):
    """The vocabulary at a path, loaded once per process; special tokens in a text are ordinary text."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.encode_special_tokens = True
    return out


@dataclass
class Piece:
    """An encoded piece [start, end) of a text: its words' starts (in the text), each word's first token, and the ids."""

    start: int
    end: int
    starts: list[int]
    first: list[int]
    ids: list[int]


@dataclass
class Seam:
    """A join under way: the left piece's words that stay, and how many words of the right piece the window takes in."""

    text: str
    left: Piece
    right: Piece
    keep: int
    begin: int
    reach: int = 3

    @property
    def end(self) -> int:
        return self.right.starts[self.reach] if self.reach < len(self.right.starts) else self.right.end


@functools.lru_cache(maxsize=65_536)
def tree_of(length: int, leaf: int) -> tuple[tuple[tuple[int, int], ...], tuple[tuple[tuple[int, int], ...], ...]]:
    """The leaves (spans) of a text's tree by halving, and by height the pairs of neighbouring nodes to join; leaves are
    numbered first, then the joins in their order."""
    leaves: list[tuple[int, int]] = []
    heights: list[list[tuple]] = []

    def build(start: int, end: int) -> tuple:
        if end - start <= leaf:
            leaves.append((start, end))
            return (0, len(leaves) - 1)
        middle = (start + end) // 2
        a, b = build(start, middle), build(middle, end)
        height = max(a[0], b[0]) + 1
        if len(heights) < height:
            heights.append([])
        heights[height - 1].append((a, b))
        return (height, len(heights[height - 1]) - 1)

    build(0, length)
    base = [0, len(leaves)]
    for h in heights:
        base.append(base[-1] + len(h))
    return tuple(leaves), tuple(tuple((base[a[0]] + a[1], base[b[0]] + b[1]) for a, b in h) for h in heights)


class Tree:
    """Encodes and decodes over trees with leaves of at most ``leaf`` characters."""

    def __init__(self, path: str, leaf: int = LEAF):
        if leaf < 1:
            raise ValueError("a leaf has at least one character")
        self.vocabulary, self.leaf = tokenizer(path), leaf
        #: Joins made and windows encoded for them.
        self.joins = self.windows = 0

    def pieces(self, parts: list[tuple[str, int, int]], whole: bool = False) -> list[Piece]:
        """The encodings of spans of texts; with ``whole``, a span that is its text comes without words."""
        out = []
        for (text, start, end), e in zip(parts, self.vocabulary.encode_batch([t[a:b] for t, a, b in parts], add_special_tokens=False), strict=True):
            if whole and start == 0 and end == len(text):  # no join will ask for its words
                out.append(Piece(start, end, [], [], e.ids))
                continue
            words, offsets = e.word_ids, e.offsets
            first = [0] if words else []
            first += [i for i, (a, b) in enumerate(zip(words, words[1:], strict=False), 1) if a != b]
            out.append(Piece(start, end, [start + offsets[i][0] for i in first], first, e.ids))
        return out

    @staticmethod
    def settled(text: str, p: Piece) -> int:
        """How many of the piece's words keep their place whatever follows the piece."""
        n = len(p.starts)
        first_open = n
        for i in range(n - 1, max(-1, n - 1 - CONTRACTION - 1), -1):
            begin, end = p.starts[i], p.starts[i + 1] if i + 1 < n else p.end
            seen = end
            if text[begin:end].isspace():
                while seen < p.end and text[seen].isspace():
                    seen += 1
            if seen >= p.end or text[begin] == "'" and begin + CONTRACTION > p.end:
                first_open = i
        return first_open

    def _joined(self, s: Seam, window: Piece) -> Piece | None:
        """The join by a window; None if it has to grow."""
        left, right = s.left, s.right
        last = window.end == right.end
        upto = len(window.starts) if last else self.settled(s.text, window)
        for at in range(bisect.bisect_left(window.starts, right.start, 0, upto), upto):
            meet = bisect.bisect_left(right.starts, window.starts[at])
            if meet < len(right.starts) and right.starts[meet] == window.starts[at]:
                break
        else:
            if not last:
                return None
            meet, at = len(right.starts), len(window.starts)
        a = left.first[s.keep] if s.keep < len(left.first) else len(left.ids)
        b = window.first[at] if at < len(window.first) else len(window.ids)
        c = right.first[meet] if meet < len(right.first) else len(right.ids)
        return Piece(
            left.start, right.end, left.starts[: s.keep] + window.starts[:at] + right.starts[meet:],
            left.first[: s.keep] + [a + x for x in window.first[:at]] + [a + b - c + x for x in right.first[meet:]], left.ids[:a] + window.ids[:b] + right.ids[c:],
        )

    def join(self, pairs: list[tuple[str, Piece, Piece]]) -> list[Piece]:
        """The encodings of pairs of neighbours, each as one piece."""
        out: list[Piece | None] = [None] * len(pairs)
        seams: dict[int, Seam] = {}
        for i, (text, left, right) in enumerate(pairs):
            keep = self.settled(text, left)
            seams[i] = Seam(text, left, right, keep, left.starts[keep] if keep < len(left.starts) else left.end)
        self.joins += len(seams)
        while seams:
            self.windows += len(seams)
            for (i, s), window in zip(list(seams.items()), self.pieces([(s.text, s.begin, s.end) for s in seams.values()]), strict=True):
                out[i] = self._joined(s, window)
                if out[i] is None:
                    s.reach *= 2
                else:
                    del seams[i]
        return out

    def encode_all(self, texts: list[str | None]) -> list[list[int]]:
        """The ids of many texts, none for an empty or null one: leaves first, then all trees joined height by height."""
        trees = {i: tree_of(len(t), self.leaf) for i, t in enumerate(texts) if t}
        leaves = self.pieces([(texts[i], a, b) for i, (spans, _) in trees.items() for a, b in spans], True)
        nodes, at = {}, 0
        for i, (spans, _) in trees.items():
            nodes[i] = leaves[at : at + len(spans)]
            at += len(spans)
        for height in range(max((len(h) for _, h in trees.values()), default=0)):
            wanted = [(i, a, b) for i, (_, h) in trees.items() if height < len(h) for a, b in h[height]]
            for (i, _, _), piece in zip(wanted, self.join([(texts[i], nodes[i][a], nodes[i][b]) for i, a, b in wanted]), strict=True):
                nodes[i].append(piece)
        return [nodes[i][-1].ids if i in nodes else [] for i in range(len(texts))]

    def encode(self, text: str | None) -> list[int]:
        """The ids of a text; none for an empty or null one."""
        return self.encode_all([text])[0]

    def decode_bytes(self, ids: list[int]) -> bytes:
        """The bytes of ids: halves are decoded and concatenated up the tree."""
        if len(ids) <= self.leaf:
            return b"".join(_token_bytes(self.vocabulary, i) for i in ids)
        middle = len(ids) // 2
        return self.decode_bytes(ids[:middle]) + self.decode_bytes(ids[middle:])

    def decode(self, ids: list[int]) -> str:
        return self.decode_bytes(ids).decode()


@functools.cache
def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the
    others, in order, for the characters from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _token_bytes(vocabulary, i: int) -> bytes:
    return bytes(_byte_of()[c] for c in vocabulary.id_to_token(i))


def _mapper(path: str, leaf: int, names: list[str], ids: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(path, leaf)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                encoded = tree.encode_all(part.column("_text").to_pylist())
                last = pa.array(encoded, pa.list_(pa.int32())) if ids else pa.array([len(e) for e in encoded], pa.int64())
                yield pa.RecordBatch.from_arrays([*[part.column(n) for n in names], last], names=[*names, "ids" if ids else "n_tokens"])

    return run


def _mapped(df: DataFrame, keep: list[str], text: str, path: str | None, leaf: int, ids: bool) -> DataFrame:
    rows = df.select(*keep, F.col(text).cast("string").alias("_text"))
    kept = ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1])
    return rows.mapInArrow(_mapper(path or default_vocabulary(), leaf, keep, ids), f"{kept}, {'ids array<int>' if ids else 'n_tokens long'}")


def token_ids(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """The kept columns and ``ids`` (without special tokens, whose strings are ordinary text) of every row.

    An empty and a null text have an empty list. Rows are independent: repeated ones and null keys stay as they are,
    columns not kept are ignored. ``path``: the vocabulary's file, on every worker.
    """
    return _mapped(df, list(keep), text, path, leaf, True)


def token_counts(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), text: str = "text", path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """The kept columns and ``n_tokens``, the number of ids of ``token_ids``."""
    return _mapped(df, list(keep), text, path, leaf, False)


def decoded(df: DataFrame, keep: tuple[str, ...] = ("doc_id",), path: str | None = None, leaf: int = LEAF) -> DataFrame:
    """The kept columns and ``text``, decoded from ``ids``; null for null."""
    rows = df.select(*keep, F.col("ids").alias("_ids"))
    names, vocabulary = list(keep), path or default_vocabulary()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tree = Tree(vocabulary, leaf)
        for b in batches:
            texts = pa.array([None if i is None else tree.decode(i) for i in b.column("_ids").to_pylist()], pa.string())
            yield pa.RecordBatch.from_arrays([*[b.column(n) for n in names], texts], names=[*names, "text"])

    return rows.mapInArrow(run, ", ".join(f"`{n}` {t}" for n, t in rows.dtypes[:-1]) + ", text string")
