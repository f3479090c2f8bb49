"""Edit-aware token counts: a tree of pre-token blocks per document, updated only where an edit touches it."""

from __future__ import annotations

from collections.abc import Iterator, Mapping

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BLOCK = 32
CONTEXT = 4
CACHE = 300_000

#: What an editor of personal data replaces in texts, by the mark put in its place.
REDACTIONS: Mapping[str, str] = {
    "<email>": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "<ip>": r"\b(?:\d{1,3}\.){3}\d{1,3}\b",
    "<phone>": r"\+?\d[\d ()-]{7,}\d",
}

STATE = "text string, n_tokens long, block_chars array<int>, block_tokens array<int>"
EDITS = "array<struct<start:int,stop:int,text:string>>"


class Counter:
    """Token counts of pre-tokens under a byte-level BPE; a pre-token's count does not depend on its neighbours."""

    def __init__(self, path: str):
        import base64

        import public_tokenizers
        import tiktoken

        with open(path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pattern = regex.compile(public_tokenizers.PATTERN)
        self.cache: dict[str, int] = {}

    def split(self, text: str) -> list[str]:
        return self.pattern.findall(text)

    def count(self, part: str) -> int:
        n = self.cache.get(part)
        if n is None:
            if len(self.cache) >= CACHE:
                self.cache = {}
            n = len(self.encoding.encode_ordinary(part))
            self.cache[part] = n
        return n

    def blocks(self, text: str) -> tuple[list[int], list[int]]:
        """Characters and tokens of each block of ``BLOCK`` pre-tokens of a text."""
        parts = self.split(text)
        count, cache = self.count, self.cache
        sizes = [n if (n := cache.get(p)) is not None else count(p) for p in parts]
        chars = np.fromiter(map(len, parts), np.int64, len(parts))
        at = np.arange(0, len(parts), BLOCK)
        if not len(at):
            return [], []
        return np.add.reduceat(chars, at).tolist(), np.add.reduceat(np.array(sizes, np.int64), at).tolist()


class Tree:
    """A segment tree with the characters and tokens of each block in its leaves and their sums above."""

    def __init__(self, chars: list[int], tokens: list[int]):
        self.size = 1 << max(0, (len(chars) - 1).bit_length())
        self.sums = np.zeros((2 * self.size, 2), np.int64)
        self.sums[self.size : self.size + len(chars), 0] = chars
        self.sums[self.size : self.size + len(chars), 1] = tokens
        level = self.size
        while level > 1:
            self.sums[level // 2 : level] = self.sums[level : 2 * level : 2] + self.sums[level + 1 : 2 * level : 2]
            level //= 2

    @property
    def tokens(self) -> int:
        return int(self.sums[1, 1])

    @property
    def blocks(self) -> tuple[list[int], list[int]]:
        """Characters and tokens of the leaves that hold any, in order: what a tree is made from again."""
        leaves = self.sums[self.size :]
        leaves = leaves[leaves[:, 0] > 0]
        return leaves[:, 0].tolist(), leaves[:, 1].tolist()

    def leaf(self, i: int) -> int:
        return int(self.sums[self.size + i, 0])

    def find(self, at: int) -> tuple[int, int]:
        """The leaf that holds character ``at`` (the last one that holds any, beyond the end), and where it begins."""
        at, node, start = min(at, int(self.sums[1, 0]) - 1), 1, 0
        while node < self.size:
            node *= 2
            if at - start >= self.sums[node, 0]:
                start += int(self.sums[node, 0])
                node += 1
        return node - self.size, start

    def put(self, i: int, chars: int, tokens: int) -> None:
        node = self.size + i
        change = np.array([chars, tokens]) - self.sums[node]
        while node:
            self.sums[node] += change
            node //= 2


class Edited:
    """A text that is edited from its end to its start: what lies right of the last edit are pieces, joined once at the end."""

    def __init__(self, text: str):
        self.text, self.free, self.size = text, len(text), len(text)
        self.pieces: list[str] = []  # the rightmost first

    def replace(self, start: int, stop: int, new: str) -> None:
        """Put ``new`` for [start, stop), which ends where the edit before it starts, or further left."""
        self.pieces += [self.text[stop : self.free], new]
        self.size += len(new) - (stop - start)
        self.free = start

    def part(self, begin: int, end: int) -> str:
        """The characters [begin, end) of the text as it is now; takes time in proportion to them and the edits in them."""
        found, left = [self.text[begin : min(end, self.free)]], end - max(begin, self.free)
        skip = max(0, begin - self.free)
        for piece in reversed(self.pieces):
            if left <= 0:
                break
            if skip >= len(piece):
                skip -= len(piece)
                continue
            found.append(piece[skip : skip + left])
            left -= len(found[-1])
            skip = 0
        return "".join(found)

    def whole(self) -> str:
        return "".join([self.text[: self.free], *reversed(self.pieces)])


def apply_edit(counter: Counter, tree: Tree, text: Edited, start: int, stop: int, new: str) -> int:
    """Edits ``text``, brings ``tree`` up to date, and gives how many characters were encoded again.

    Encoding starts at the block that holds the last ``CONTEXT`` characters before the edit, as a pre-token that
    ends further left looked at nothing that changed. It goes on over whole old blocks until the new pre-tokens have
    a boundary where an old block ends, ``CONTEXT`` characters or more past the edit; from there on all pre-tokens
    are as before. The first touched leaf takes the sums of all that was encoded; the other touched ones become empty.
    """
    size = text.size
    text.replace(start, stop, new)
    if not size:
        tree.put(0, text.size, sum(map(counter.count, counter.split(text.whole()))))
        return text.size
    first, begin = tree.find(max(0, start - CONTEXT))
    last, at = tree.find(max(stop, begin))
    end = at + tree.leaf(last)
    shift = len(new) - (stop - start)
    while True:
        # look a block further than what is kept, so that the end of the window changes nothing that counts
        more = end
        if end < size:
            ahead, at = tree.find(end)
            more = at + tree.leaf(ahead)
        parts = counter.split(text.part(begin, more + shift))
        bounds = begin + np.cumsum([0, *map(len, parts)])
        if more == end:
            break
        if more - end >= CONTEXT and end - stop >= CONTEXT and end + shift in bounds:
            parts = parts[: int(np.searchsorted(bounds, end + shift))]
            break
        last, end = ahead, more
    tree.put(first, end + shift - begin, sum(map(counter.count, parts)))
    for i in range(first + 1, last + 1):
        tree.put(i, 0, 0)
    return end + shift - begin


INTS = pa.list_(pa.int32())


def counted(counter: Counter, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of id and text with the counts and blocks of each text."""
    for batch in batches:
        chars, tokens = [], []
        for text in batch["text"].to_pylist():
            c, t = counter.blocks(text)
            chars.append(c)
            tokens.append(t)
        yield pa.RecordBatch.from_arrays(
            [batch["id"], batch["text"], pa.array([sum(t) for t in tokens], pa.int64()), pa.array(chars, INTS), pa.array(tokens, INTS)],
            ["id", "text", "n_tokens", "block_chars", "block_tokens"],
        )


def redacted(patterns: Mapping[str, str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches with a text, and the edits that put marks for what the patterns match in it."""
    find = regex.compile("|".join(f"(?P<p{i}>{p})" for i, p in enumerate(patterns.values())))
    marks, kind = list(patterns), pa.list_(pa.struct([("start", pa.int32()), ("stop", pa.int32()), ("text", pa.string())]))
    for batch in batches:
        edits = [
            [{"start": m.start(), "stop": m.end(), "text": marks[int(m.lastgroup[1:])]} for m in find.finditer(t)]
            for t in batch["text"].to_pylist()
        ]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(edits, kind)], [*batch.schema.names, "edits"])


def recounted(counter: Counter, keep: bool, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of a state with edits, after these: the state, with ``keep``, or the counts."""
    for batch in batches:
        n, after, chars, encoded, texts, blocks = [], [], [], [], [], []
        rows = [batch[c].to_pylist() for c in ("text", "edits", "block_chars", "block_tokens", "n_tokens")]
        for text, edits, block_chars, block_tokens, before in zip(*rows, strict=True):
            taken, free = [], 0
            for e in sorted(edits or (), key=lambda e: (e["start"], e["stop"])):
                a, b = max(0, min(e["start"], len(text))), max(0, min(e["stop"], len(text)))
                if a >= free and b >= a:
                    taken.append((a, b, e["text"] or ""))
                    free = b
            work, now = 0, Edited(text)
            if taken:
                tree = Tree(block_chars, block_tokens)
                for a, b, new in reversed(taken):  # from the right, so that positions further left stay true
                    work += apply_edit(counter, tree, now, a, b, new)
                before = tree.tokens
                if keep:
                    block_chars, block_tokens = tree.blocks
            if keep:
                texts.append(now.whole())
                blocks.append((block_chars, block_tokens))
            n.append(len(taken))
            after.append(before)
            chars.append(now.size)
            encoded.append(work)
        if keep:
            yield pa.RecordBatch.from_arrays(
                [batch["id"], pa.array(texts, pa.string()), pa.array(after, pa.int64()), *(pa.array([b[i] for b in blocks], INTS) for i in (0, 1))],
                ["id", "text", "n_tokens", "block_chars", "block_tokens"],
            )
        else:
            yield pa.RecordBatch.from_arrays(
                [batch["id"], batch["n_tokens"], *(pa.array(x, pa.int64()) for x in (n, after, chars, encoded))],
                ["id", "n_tokens", "n_edits", "n_tokens_edited", "chars_edited", "chars_encoded"],
            )


COUNTS = "n_tokens long, n_edits long, n_tokens_edited long, chars_edited long, chars_encoded long"


def slim(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))


def count_tokens(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The state of every document: id, ``text``, ``n_tokens`` and its blocks' ``block_chars`` and ``block_tokens``.

    Written as a table it serves any number of later batches of edits (``recount`` with ``keep``). Null texts count as
    empty, which have no blocks; rows that repeat an id, or have none, each get their row; very long texts are counted
    whole; an empty table gives an empty result; extra columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    found = slim(docs, id_col, text_col).mapInArrow(lambda batches: counted(Counter(vocabulary), batches), f"id {kind}, {STATE}")
    return found.withColumnRenamed("id", id_col)


def find_redactions(state: DataFrame, patterns: Mapping[str, str] = REDACTIONS) -> DataFrame:
    """``state`` with ``edits``: where the patterns match its text, leftmost first and without overlap.

    An empty text has no edits, and an empty table gives an empty result; other columns of the state come along.
    """
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in state.schema.fields)
    return state.mapInArrow(lambda batches: redacted(patterns, batches), f"{fields}, edits {EDITS}")


def recount(state: DataFrame, vocabulary: str, id_col: str = "doc_id", keep: bool = False) -> DataFrame:
    """One row per row of ``state`` (of ``count_tokens``, with ``edits``): the counts before and after its edits.

    Columns: id, ``n_tokens``, ``n_edits``, ``n_tokens_edited``, ``chars_edited`` and ``chars_encoded``, the
    characters that had to be encoded again. ``edits`` are replacements of [start, stop) in the characters of the
    text as it was. They are taken in order of start, a later one that overlaps an earlier one is left out, and
    bounds outside the text are moved to its ends; a null text in an edit deletes. Null edits count as none. Null
    texts count as empty ones, which have no tokens; an insertion into them works. Repeated rows each get their
    row; an empty table gives an empty result.

    With ``keep`` the result is the state after the edits instead, as ``count_tokens`` gives it, for the next batch.
    """
    kind = state.schema[id_col].dataType.simpleString()
    renamed = state.withColumnRenamed(id_col, "id").select("id", "text", "n_tokens", "block_chars", "block_tokens", "edits")
    found = renamed.mapInArrow(lambda batches: recounted(Counter(vocabulary), keep, batches), f"id {kind}, {STATE if keep else COUNTS}")
    return found.withColumnRenamed("id", id_col)


def count_redacted(
    docs: DataFrame, vocabulary: str, patterns: Mapping[str, str] = REDACTIONS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The counts of ``recount`` for the redactions of every document, with no state kept between: each text goes to Python once.

    The rows equal those of ``recount(find_redactions(count_tokens(docs)))``. Null texts count as empty; rows that repeat an id,
    or have none, each get their row; very long texts are counted whole, in time linear in their characters and edits; an
    empty table gives an empty result; extra columns are ignored.
    """
    kind = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(vocabulary)
        return recounted(counter, False, redacted(patterns, counted(counter, batches)))

    return slim(docs, id_col, text_col).mapInArrow(each, f"id {kind}, {COUNTS}").withColumnRenamed("id", id_col)
