"""Token counts that follow edits: a segment tree of pre-tokens for each document.

A byte-pair tokenizer cuts a text into pre-tokens and encodes each by itself, so a
document's count is the sum over its pre-tokens. The tree's leaves hold up to
``LEAF`` pre-tokens (characters and tokens of each), inner nodes the sums of their
subtrees. An edit finds its leaves by character offset, cuts the touched region and
as much context anew as the pattern can see, replaces these leaves and updates the
sums on the path up; all other pre-tokens stay as they were.

Trees are plain array columns (pre-tokens, ends of the leaves, sums of all nodes), so
they can be stored and edited again later: an edit reads its leaves and its paths, and
sums nothing else again.
"""

import base64
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, doc_and, python_tasks, table

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: how byte-level BPE vocabularies of this kind cut a text.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Characters after a pre-token that the pattern may look at to end it (white space before a word, `'ll`).
LOOKS_AHEAD = 2
LEAF = 32
REMEMBERED = 300_000


class Encoder(dict):
    """Tokens of a pre-token, found once: ``self[piece]``."""

    def __init__(self, path: str):
        super().__init__()
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(PATTERN)

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self.encoding.encode_ordinary(piece))
        return n

    def pieces(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of each pre-token."""
        if len(self) > REMEMBERED:
            self.clear()
        found = self.pattern.findall(text)
        return list(map(len, found)), list(map(self.__getitem__, found))


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a vocabulary file."""
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


class Tree:
    """Sums of characters and tokens over leaves of pre-tokens.

    Nodes are in one array a sum, the root at 1 and the children of ``i`` at ``2 * i`` and
    ``2 * i + 1``. Leaves are slices of the arrays that the tree came from (``ends`` are
    their ends) until one is set; ``set`` changes the sums on its path only. A long
    insertion makes more leaves and builds the sums anew, from the sums of the leaves.
    """

    def __init__(self, chars, tokens, leaf: int = LEAF):
        self.leaf = leaf
        self._cut(np.asarray(chars, np.int32), np.asarray(tokens, np.int32), [min(i + leaf, len(chars)) for i in range(0, max(1, len(chars)), leaf)])
        self._build([(int(self.all_chars[a:b].sum()), int(self.all_tokens[a:b].sum())) for a, b in zip([0, *self.ends], self.ends)])

    def _cut(self, chars: np.ndarray, tokens: np.ndarray, ends) -> None:
        self.all_chars, self.all_tokens, self.ends = chars, tokens, ends
        self.fresh: dict[int, tuple[list[int], list[int]]] = {}
        self.n_leaves = len(ends)

    @classmethod
    def stored(cls, chars: np.ndarray, tokens: np.ndarray, ends: np.ndarray, char_sums: np.ndarray, token_sums: np.ndarray) -> "Tree":
        """A tree as it was stored: nothing is summed again."""
        tree = cls.__new__(cls)
        tree.leaf = LEAF
        tree._cut(chars, tokens, ends)
        tree.chars, tree.tokens = char_sums.copy(), token_sums.copy()
        tree.size = len(char_sums) // 2
        return tree

    def _build(self, sums: list[tuple[int, int]]) -> None:
        self.size = 1 << max(0, len(sums) - 1).bit_length()
        self.chars, self.tokens = np.zeros(2 * self.size, np.int32), np.zeros(2 * self.size, np.int32)
        self.chars[self.size : self.size + len(sums)], self.tokens[self.size : self.size + len(sums)] = zip(*sums)
        width = self.size
        while width > 1:
            for nodes in (self.chars, self.tokens):
                nodes[width // 2 : width] = nodes[width : 2 * width].reshape(-1, 2).sum(1)
            width //= 2

    @property
    def total(self) -> tuple[int, int]:
        return int(self.chars[1]), int(self.tokens[1])

    def at(self, place: int) -> tuple[list[int], list[int]]:
        """Characters and tokens of the pre-tokens of a leaf."""
        if place not in self.fresh:
            a, b = self.ends[place - 1] if place else 0, self.ends[place]
            self.fresh[place] = self.all_chars[a:b].tolist(), self.all_tokens[a:b].tolist()
        return self.fresh[place]

    def find(self, offset: int) -> tuple[int, int]:
        """The leaf that holds the character at ``offset`` (or the last), and the offset of its start."""
        node, start = 1, 0
        while node < self.size:
            node *= 2
            if offset >= start + self.chars[node]:
                if self.chars[node + 1] == 0:  # nothing to the right
                    continue
                start += int(self.chars[node])
                node += 1
        return node - self.size, start

    def set(self, place: int, chars: list[int], tokens: list[int]) -> None:
        """New pre-tokens for a leaf; sums change on its path only."""
        self.fresh[place] = (chars, tokens)
        node = self.size + place
        more = sum(chars) - int(self.chars[node]), sum(tokens) - int(self.tokens[node])
        while node:
            self.chars[node] += more[0]
            self.tokens[node] += more[1]
            node //= 2

    def widen(self, place: int, leaves: list[tuple[list[int], list[int]]]) -> None:
        """Several leaves in the place of one."""
        sums = [(int(self.chars[self.size + i]), int(self.tokens[self.size + i])) for i in range(self.n_leaves)]
        sums[place : place + 1] = [(sum(chars), sum(tokens)) for chars, tokens in leaves]
        self.fresh[place] = [c for chars, _ in leaves for c in chars], [t for _, tokens in leaves for t in tokens]
        chars, tokens, ends = self.arrays()
        ends = ends.tolist()
        inner = np.cumsum([len(c) for c, _ in leaves]) + (ends[place - 1] if place else 0)
        self._cut(chars, tokens, [*ends[:place], *inner.tolist(), *ends[place + 1 :]])
        self._build(sums)

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Characters and tokens of all pre-tokens, and the ends of the leaves."""
        if not self.fresh:
            return self.all_chars, self.all_tokens, np.asarray(self.ends, np.int32)
        chars, tokens, sizes, done = [], [], np.diff(np.asarray(self.ends), prepend=0), 0
        for place in sorted(self.fresh):
            a, b = self.ends[place - 1] if place else 0, self.ends[place]
            own = self.fresh[place]
            chars += [self.all_chars[done:a], np.array(own[0], np.int32)]
            tokens += [self.all_tokens[done:a], np.array(own[1], np.int32)]
            sizes[place], done = len(own[0]), b
        chars.append(self.all_chars[done:])
        tokens.append(self.all_tokens[done:])
        return np.concatenate(chars), np.concatenate(tokens), np.cumsum(sizes).astype(np.int32)

    def pieces(self) -> tuple[list[int], list[int]]:
        chars, tokens, _ = self.arrays()
        return chars.tolist(), tokens.tolist()


def edit(text: str, tree: Tree, start: int, length: int, new: str, enc: Encoder) -> tuple[str, int]:
    """Replace ``length`` characters at ``start`` by ``new``; the text, and the pre-tokens cut anew."""
    start = min(max(start, 0), len(text))
    stop = min(start + max(length, 0), len(text))
    changed = text[:start] + new + text[stop:]
    shift = len(changed) - len(text)
    # The pre-tokens before the first one that saw the edit stay: those that ended with all they look at before it.
    place, at = tree.find(max(0, start - LOOKS_AHEAD))
    chars, tokens = tree.at(place)
    keep, begin = 0, at
    while keep < len(chars) and begin + chars[keep] + LOOKS_AHEAD <= start:
        begin += chars[keep]
        keep += 1
    # Old boundaries after the edit, read leaf by leaf as they are needed.
    last, end_place, old, old_keep = begin, place, keep, None
    fresh: tuple[list[int], list[int]] = ([], [])
    where = begin
    for match in enc.pattern.finditer(changed, begin):
        # Move the old boundary up to this one; from a common one behind the edit all is as before.
        if where >= start + len(new):
            while last + shift < where or last < stop:
                if old == len(tree.at(end_place)[0]):
                    if end_place + 1 == tree.n_leaves:
                        break
                    end_place, old = end_place + 1, 0
                    continue
                last += tree.at(end_place)[0][old]
                old += 1
            if last + shift == where and last >= stop:
                old_keep = old
                break
        piece = match[0]
        fresh[0].append(len(piece))
        fresh[1].append(enc[piece])
        where = match.end()
    if old_keep is None:  # up to the end of the text
        end_place = tree.n_leaves - 1
        old_keep = len(tree.at(end_place)[0])
    rest = tree.at(end_place)
    new_chars = chars[:keep] + fresh[0] + rest[0][old_keep:]
    new_tokens = tokens[:keep] + fresh[1] + rest[1][old_keep:]
    for gone in range(place + 1, end_place + 1):
        tree.set(gone, [], [])
    if len(new_chars) <= 4 * tree.leaf:
        tree.set(place, new_chars, new_tokens)
    else:  # a long insertion: more leaves
        size = tree.leaf
        tree.widen(place, [(new_chars[i : i + size], new_tokens[i : i + size]) for i in range(0, len(new_chars), size)])
    return changed, len(fresh[0])


TREE = "chars array<int>, tokens array<int>, ends array<int>, char_sums array<int>, token_sums array<int>"
EDITS = "array<struct<start:int,length:int,text:string>>"
_INTS = pa.list_(pa.int32())
COLUMNS = [part.split()[0] for part in TREE.split(", ")]


def _columns(trees: list[Tree]) -> list[pa.Array]:
    """The arrays of trees as columns of lists."""
    parts = zip(*((*tree.arrays(), tree.chars, tree.tokens) for tree in trees))
    out = []
    for arrays in parts:
        ends = np.zeros(len(arrays) + 1, np.int32)
        np.cumsum([len(a) for a in arrays], out=ends[1:])
        out.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(arrays).astype(np.int32))))
    return out


def _slices(column: pa.Array) -> list[np.ndarray]:
    """The lists of a column, as views."""
    flat, ends = column.flatten().to_numpy(zero_copy_only=False), column.offsets.to_numpy()
    ends = ends - ends[0]
    return [flat[a:b] for a, b in zip(ends[:-1], ends[1:])]


def _built(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in chunks(batches):
        trees = [Tree(*enc.pieces(t or "")) for t in batch.column("text").to_pylist()]
        names = ["doc", "edits", "text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *_columns(trees)], names=[*names, *COLUMNS])


def build_trees(docs: DataFrame, edits: Column | None = None, path: str = TOKENIZER) -> DataFrame:
    """The struct ``doc`` with all columns of ``docs``, ``edits``, ``text`` and the leaves of its tree.

    ``chars`` and ``tokens`` belong to each pre-token; ``edits`` (a column of ``docs``,
    by default none) wait for :func:`apply_edits`. Null and empty texts have no pre-token.
    """
    python_tasks(docs.sparkSession)
    edits = F.lit(None) if edits is None else edits
    rows = docs.select(F.struct("*").alias("doc"), edits.cast(EDITS).alias("edits"), F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(lambda it: _built(it, path), doc_and(rows, f"edits {EDITS}, text string, {TREE}"))


def _edited(batches: Iterable[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    enc = encoder(path)
    for batch in chunks(batches):
        rows, trees = [], []
        parts = zip(*(_slices(batch.column(n)) for n in COLUMNS))
        for text, edits, arrays in zip(batch.column("text").to_pylist(), batch.column("edits").to_pylist(), parts):
            tree = Tree.stored(*arrays)
            text, before, anew = text or "", tree.total[1], 0
            for e in edits or ():
                text, cut = edit(text, tree, e["start"] or 0, e["length"] or 0, e["text"] or "", enc)
                anew += cut
            rows.append((text, before, tree.total[1], anew, len(edits or ())))
            trees.append(tree)
        kinds = (pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
        names = ["text", "n_tokens_before", "n_tokens", "n_pieces_cut", "n_edits"]
        arrays = [pa.array(c, k) for c, k in zip(zip(*rows), kinds)]
        yield pa.RecordBatch.from_arrays([batch.column("doc"), *arrays, *_columns(trees)], names=["doc", *names, *COLUMNS])


def apply_edits(trees: DataFrame, path: str = TOKENIZER) -> DataFrame:
    """Trees after their ``edits``: an array of (start, length, text) in characters, applied in order.

    Takes the columns of :func:`build_trees`; returns ``doc``, the edited ``text``,
    its leaves, ``n_tokens_before``, ``n_tokens``, ``n_pieces_cut`` (pre-tokens cut
    anew) and ``n_edits``. Places beyond the text are its end; null parts are 0 or
    empty; null edits are none.
    """
    python_tasks(trees.sparkSession)
    counts = "n_tokens_before long, n_tokens long, n_pieces_cut long, n_edits long"
    return trees.mapInArrow(lambda it: _edited(it, path), doc_and(trees, f"text string, {counts}, {TREE}"))


def sample_edits(text: str = "text", seed: str = "doc_id") -> Column:
    """Three edits that follow from the text and ``seed``: a deletion, an insertion and a replacement."""
    text = f"coalesce({text}, '')"
    n, h = f"length({text})", f"xxhash64({seed})"
    return F.expr(
        f"""array(
          named_struct('start', cast(pmod({h}, {n} + 1) as int), 'length', 7, 'text', ''),
          named_struct('start', cast(pmod(shiftright({h}, 9), {n} + 1) as int), 'length', 0, 'text', substr({text}, 1, 40)),
          named_struct('start', cast(pmod(shiftright({h}, 18), {n} + 1) as int), 'length', 25, 'text', ' {{edited}} it''s 2 '))"""
    )


def op5_edit_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return apply_edits(build_trees(docs, sample_edits())).select(
        "doc.doc_id",
        "n_tokens_before",
        "n_tokens",
        "n_edits",
        "n_pieces_cut",
        F.size("chars").cast("long").alias("n_pieces"),
        F.length("text").cast("long").alias("n_chars"),
        F.crc32("text").alias("text_crc32"),
    )
