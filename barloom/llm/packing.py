"""Best-fit packing of tokenised documents into sequences, improved by swap-based local search."""

from __future__ import annotations

import heapq
import os
import zlib
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_batches, buckets, give_back, materialise

PER_GROUP = 16_384
BATCH_BYTES = 3_000_000
CACHE = 300_000
#: Chunks of Latin letters and a run of ASCII punctuation after them, either of which may be missing: the tokenizer splits them there.
SIMPLE = r"^([a-zÀ-ÖØ-öø-ÿ]*)([!-/:-@\[-`{-~]*)$"


class WordTable:
    """Token ids of whole texts from a file of the ``tokenizers`` library, encoding each distinct word once.

    The tokenizer splits texts at blanks and between letters and punctuation before it merges, so a text's ids are
    its parts' ids in turn. Parts (words of Latin letters, runs of punctuation) go through a table of up to ``CACHE``
    parts, held as arrays: what the table has is found in one lookup, and what it lacks is encoded in lines of parts.
    All other chunks go through the tokenizer as they are, and so do whole texts in which a special token may hide.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core; threads of its own each hold memory
        from tokenizers import Tokenizer
        from tokenizers import pre_tokenizers as pre

        self.whole = Tokenizer.from_file(path)
        self.words = Tokenizer.from_file(path)  # for parts already normalised: the costly steps are left out
        self.words.normalizer = None
        self.words.pre_tokenizer = pre.Sequence(
            [pre.WhitespaceSplit(), pre.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        end = self.whole.model.end_of_word_suffix
        self.ends = np.zeros(self.whole.get_vocab_size(), bool)
        self.ends[[i for token, i in self.whole.get_vocab().items() if end and token.endswith(end)]] = True
        self.known = pa.array([], pa.string())
        self.size = np.zeros(0, np.int32)
        self.flat = np.zeros(0, np.uint32)

    def _encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Numbers of ids of the texts, and all their ids in turn, by the tokenizer as it is."""
        ids = [e.ids for e in self.whole.encode_batch_fast(texts, add_special_tokens=False)]
        size = np.fromiter(map(len, ids), np.int32, len(ids))
        return size, np.fromiter(chain.from_iterable(ids), np.uint32, int(size.sum()))

    def _learn(self, parts: list[str]) -> None:
        size, flat = [self.size], [self.flat]
        for at in range(0, len(parts), 512):
            some = parts[at : at + 512]
            ids = np.array(self.words.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, np.uint32)
            cuts = np.flatnonzero(self.ends[ids]) + 1
            own = (np.diff(cuts, prepend=0).astype(np.int32), ids) if len(cuts) == len(some) else self._encode(some)
            size.append(own[0])
            flat.append(own[1])
        self.known = pa.concat_arrays([self.known, pa.array(parts, pa.string())])
        self.size, self.flat = np.concatenate(size), np.concatenate(flat)

    def _lookup(self, parts: pa.Array) -> np.ndarray:
        """The place in the table of each of the distinct ``parts``."""
        at = pc.index_in(parts, value_set=self.known)
        new = parts.filter(at.is_null())
        if len(self.known) + len(new) > CACHE:  # only what this batch needs stays
            stay = np.sort(at.drop_null().to_numpy())
            self.flat = self.flat[_ranges(np.cumsum(self.size)[stay] - self.size[stay], self.size[stay])]
            self.known, self.size = self.known.take(pa.array(stay)), self.size[stay]
        self._learn(new.to_pylist())
        return pc.index_in(parts, value_set=self.known).to_numpy()

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and where each text's ids begin (one more bound at the end)."""
        whole = pc.match_substring(texts, "<|")
        plain = pc.if_else(whole, "", texts)
        split = pc.ascii_split_whitespace(pc.ascii_lower(plain))
        of_text = np.concatenate([[0], np.cumsum(pc.list_value_length(split).to_numpy(zero_copy_only=False))])
        chunks = split.flatten().dictionary_encode()
        del plain, split
        # a text that is blank on either side gives empty chunks there, which have no ids
        distinct = chunks.dictionary
        simple = pc.match_substring_regex(distinct, SIMPLE)
        words = pc.utf8_lower(distinct.filter(simple))  # each of these letters has one lower-case form
        halves = pa.concat_arrays([pc.replace_substring_regex(words, SIMPLE, rf"\{i}") for i in (1, 2)]).dictionary_encode()
        place = self._lookup(halves.dictionary)[halves.indices.to_numpy()]
        is_simple = simple.to_numpy(zero_copy_only=False).astype(bool)
        odd_size, odd_flat = self._encode(distinct.filter(pc.invert(simple)).to_pylist())
        # each distinct chunk is two ranges of ids in the table, or one of the odd ones and an empty one
        begin, size = np.zeros((2, len(distinct), 2), np.int64)
        ends = np.cumsum(self.size, dtype=np.int64)
        begin[is_simple], size[is_simple] = (x[place].reshape(2, -1).T for x in (ends - self.size, self.size))
        begin[~is_simple, 0], size[~is_simple, 0] = len(self.flat) + np.cumsum(odd_size) - odd_size, odd_size
        flat = np.concatenate([self.flat, odd_flat])[_ranges(begin.ravel(), size.ravel())]
        n = size.sum(axis=1)
        code = chunks.indices.to_numpy(zero_copy_only=False)
        del chunks, distinct, words, halves
        ids = flat[_ranges((np.cumsum(n) - n)[code], n[code])]
        bounds = np.concatenate([[0], np.cumsum(n[code])])[of_text]
        if any_whole := np.flatnonzero(whole.to_numpy(zero_copy_only=False)).tolist():
            parts = [ids[a:b] for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            for i in any_whole:
                parts[i] = self._encode([texts[i].as_py()])[1]
            ids = np.concatenate(parts)
            bounds = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return ids, bounds


def _ranges(begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """All whole numbers of the ranges of ``size`` numbers from ``begin`` on, in turn; a batch has far fewer than 2**31."""
    out = np.repeat((begin - (np.cumsum(size) - size)).astype(np.int32), size)
    out += np.arange(len(out), dtype=np.int32)
    return out


@lru_cache(maxsize=1)
def word_table(path: str) -> WordTable:
    """The table of this worker, which lasts over its tasks."""
    return WordTable(path)


def pieces(
    docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The pieces of every document: id, ``piece``, ``start``, ``length`` and ``ids_crc32``.

    A document is its token ids and ``end_id`` after them; one longer than ``capacity`` is cut into pieces of that
    length and a rest. ``tokenizer`` is the path of a file of the ``tokenizers`` library. A null or empty text is
    ``end_id`` alone; rows that repeat an id, or have none, are cut one by one; an empty table gives an empty result;
    extra columns are ignored.
    """
    id_type = docs.schema[id_col].dataType.simpleString()

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_table(tokenizer)
        for batch in batches:
            text = pc.fill_null(batch.column(1), "")
            size = pc.binary_length(text).to_numpy(zero_copy_only=False)
            cuts = [0, *(np.flatnonzero(np.diff(np.cumsum(size) // BATCH_BYTES)) + 1).tolist(), len(text)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                if a == b:
                    continue
                ids, bounds = words.encode(text.slice(a, b - a))
                doc, piece, start, length, crc = [], [], [], [], []
                end = np.array([end_id], np.uint32)
                for i, (lo, hi) in enumerate(zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)):
                    own = np.concatenate([ids[lo:hi], end]).astype("<u4")
                    for k, at in enumerate(range(0, len(own), capacity)):
                        part = own[at : at + capacity]
                        doc.append(a + i)
                        piece.append(k)
                        start.append(at)
                        length.append(len(part))
                        crc.append(zlib.crc32(part))
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).take(pa.array(doc, pa.int64())),
                        pa.array(piece, pa.int32()),
                        pa.array(start, pa.int64()),
                        pa.array(length, pa.int64()),
                        pa.array(crc, pa.int64()),
                    ],
                    ["id", "piece", "start", "length", "ids_crc32"],
                )
                del ids, bounds
                give_back()

    slim = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return slim.mapInArrow(each, f"id {id_type}, piece int, start long, length long, ids_crc32 long")


class Bins:
    """Bins of one group: items by bin, and, of the bins in play, those of each free space and of each item length.

    ``gap[n]`` is the largest free space of a bin in play that holds an item of length n, and ``gap[0]`` that of any
    bin; -1 where there is none. Free spaces are found by the bits of one integer for each length.
    """

    def __init__(self, capacity: int):
        self.capacity = capacity
        self.items: list[list[tuple[int, int]]] = []  # (length, item)
        self.free: list[int] = []
        self.at: dict[tuple[int, int], set[int]] = {}  # by length, or 0 for all bins, and free space
        self.mask = [0] * (capacity + 1)
        self.gap = np.full(capacity + 1, -1, np.int64)

    def enter(self, b: int) -> None:
        free = self.free[b]
        for n in {0, *(n for n, _ in self.items[b])}:
            own = self.at.setdefault((n, free), set())
            if not own:
                self.mask[n] |= 1 << free
                self.gap[n] = self.mask[n].bit_length() - 1
            own.add(b)

    def leave(self, b: int) -> None:
        free = self.free[b]
        for n in {0, *(n for n, _ in self.items[b])}:
            own = self.at[n, free]
            own.discard(b)
            if not own:
                del self.at[n, free]
                self.mask[n] &= ~(1 << free)
                self.gap[n] = self.mask[n].bit_length() - 1

    def holder(self, n: int, free: int) -> int:
        """A bin in play of that free space that holds an item of length ``n``."""
        own = self.at[n, free]
        return min(own) if len(own) <= 64 else next(iter(own))

    def tightest(self, need: int) -> int:
        """The bin in play of least free space that still holds ``need``, or -1."""
        rest = self.mask[0] >> need
        return self.holder(0, need + (rest & -rest).bit_length() - 1) if rest else -1

    def replace(self, b: int, without: list[tuple[int, int]], plus: list[tuple[int, int]]) -> None:
        """Change a bin that is in play."""
        self.leave(b)
        for x in without:
            self.items[b].remove(x)
        self.items[b] += plus
        self.free[b] += sum(n for n, _ in without) - sum(n for n, _ in plus)
        self.enter(b)

    def add(self, item: int, length: int) -> None:
        b = self.tightest(length)
        if b < 0:
            self.items.append([])
            self.free.append(self.capacity)
            b = len(self.items) - 1
            self.enter(b)
        self.replace(b, [], [(length, item)])


def _best_swap(bins: Bins, mine: list[tuple[int, int]]) -> tuple[int, int, tuple[tuple[int, int], ...]] | None:
    """The swap of one or two of ``mine`` for a shorter item that fills a bin in play most: that bin, length, what it gets.

    All bins in play, all their items and all pairs of ``mine`` take part. Of equal lengths two count at most, and a
    full bin has few different lengths, so the pairs are few.
    """
    by_length: dict[int, list[tuple[int, int]]] = {}
    for x in mine:
        by_length.setdefault(x[0], []).append(x)
    length = np.array(sorted(by_length), np.int64)
    sums = length[:, None] + length[None, :]
    twice = np.array([len(by_length[n]) > 1 for n in length.tolist()])
    pairs = sums[np.triu(np.ones(sums.shape, bool), 1) | np.diag(twice)]
    most = np.zeros(2 * bins.capacity + 1, np.int64)  # the greatest length to give that is not above x
    most[pairs] = pairs
    most[length] = length
    most = np.maximum.accumulate(most)
    gain = np.where(bins.gap > 0, most[np.arange(len(bins.gap)) + np.maximum(bins.gap, 0)] - np.arange(len(bins.gap)), 0)
    gain[0] = 0  # moves are not swaps
    take = int(gain.argmax())
    if gain[take] <= 0:
        return None
    give = take + int(gain[take])
    if give in by_length:
        return bins.holder(take, int(bins.gap[take])), take, (by_length[give][0],)
    one = next(n for n in by_length if give - n in by_length and (give != 2 * n or len(by_length[n]) > 1))
    return bins.holder(take, int(bins.gap[take])), take, (by_length[one][0], by_length[give - one][-1])


def _exchange(bins: Bins, low: int) -> bool:
    """One move that fills another bin from bin ``low``, which is out of play and the emptier: the squared fill increases.

    In turn: move one item over, the longest that fits; swap one or two for one that is shorter.
    """
    mine = sorted(bins.items[low], key=lambda x: (-x[0], x[1]))
    for x in mine:
        to = bins.tightest(x[0])
        if to >= 0:
            bins.replace(to, [], [x])
            bins.items[low].remove(x)
            bins.free[low] += x[0]
            return True
    best = _best_swap(bins, mine)
    if best is None:
        return False
    to, take, give = best
    got = min(x for x in bins.items[to] if x[0] == take)
    bins.replace(to, [got], list(give))
    for x in give:
        bins.items[low].remove(x)
    bins.items[low].append(got)
    bins.free[low] += sum(n for n, _ in give) - take
    return True


def pack(length: list[int], capacity: int) -> list[int]:
    """Bin of each item: best fit in order of length, then local search until no exchange is left.

    From the emptiest bin to the fullest, each gives to those no emptier until it is empty or none among them can take
    a move or a swap from it. Passes over all bins repeat until one finds nothing, or until what is free in all bins
    together holds no bin's contents, which no packing betters. The squared fill grows with each exchange, so that
    the search ends.
    """
    bins = Bins(capacity)
    for i in sorted(range(len(length)), key=lambda i: -length[i]):
        bins.add(i, length[i])
    slack = sum(bins.free)
    moved = True
    while moved and slack >= capacity:
        moved = False
        todo = [(-free, b) for b, free in enumerate(bins.free) if bins.items[b]]
        heapq.heapify(todo)
        stuck, tied = [], []  # bins that are done in this pass: out of play, or still in it beside others as empty
        while todo and slack >= capacity:
            free, low = heapq.heappop(todo)
            if -free != bins.free[low]:  # it was filled since
                heapq.heappush(todo, (-bins.free[low], low))
                continue
            if not free:
                break
            for b in tied:
                if bins.free[b] > bins.free[low]:
                    bins.leave(b)
                    stuck.append(b)
            tied = [b for b in tied if bins.free[b] == bins.free[low]]
            bins.leave(low)
            while bins.items[low] and _exchange(bins, low):
                moved = True
            if bins.items[low]:
                bins.enter(low)
                tied.append(low)
            else:
                slack -= capacity
        for b in stuck:
            bins.enter(b)
    out = [0] * len(length)
    for b, items in enumerate(bins.items):
        for _, i in items:
            out[i] = b
    return out


def _pack_group(capacity: int):
    def each(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in ("hash", "piece", "length", "ids_crc32", "row")])
        length = rows["length"].to_pylist()
        bin_ = np.array(pack(length, capacity), np.int64)
        order = np.argsort(bin_, kind="stable")
        n = np.array(length, np.int64)[order]
        before = np.cumsum(n) - n
        first = np.concatenate([[True], np.diff(bin_[order]) != 0])
        inside = before - np.repeat(before[first], np.diff(np.concatenate([np.flatnonzero(first), [len(n)]])))
        offset = np.empty_like(inside)
        offset[order] = inside
        fill = np.bincount(bin_, np.array(length))
        put = {"seq": bin_, "offset": offset, "fill": fill[bin_].astype(np.int64)}
        for name, values in put.items():
            rows = rows.set_column(rows.schema.get_field_index(name), name, pa.array(values, pa.int64()))
        return rows

    return each


def _deal(todo: DataFrame, draw: int, per_group: int) -> DataFrame:
    """``todo`` with ``group``: pieces go by a hash into groups of about ``per_group``.

    Only rows that repeat an id and its text share their hash; a group that many of them make twice as large, or
    larger, is dealt again by row number into groups of that size.
    """
    groups = buckets(todo.count(), per_group)
    dealt = todo.withColumn("slot", F.pmod(F.xxhash64("hash", "ids_crc32", F.lit(draw)), F.lit(groups)))
    large = dealt.groupBy("slot").count().where(F.col("count") > 2 * per_group)
    large = large.select("slot", F.ceil(F.col("count") / per_group).alias("parts"))
    own = F.pmod(F.xxhash64("row", F.lit(draw)), F.coalesce("parts", F.lit(1)))
    return dealt.join(large, "slot", "left").withColumn("group", F.col("slot") + groups * own).drop("slot", "parts")


def pack_documents(
    docs: DataFrame,
    tokenizer: str,
    capacity: int = 2048,
    end_id: int = 0,
    id_col: str = "doc_id",
    text_col: str = "text",
    per_group: int = PER_GROUP,
    good_fill: float = 0.995,
    rounds: int = 4,
) -> DataFrame:
    """One row per piece of a document: id, ``piece``, ``start``, ``length``, ``ids_crc32``, ``sequence_id``, ``offset``.

    Pieces are dealt by a hash into groups of about ``per_group`` and packed within each: best fit by length, then
    moves and exchanges of one for one and two for one from emptier bins into fuller ones, looked up over all bins
    and pieces of the group, until none is left. The pieces of bins filled to less than ``good_fill`` meet again in
    the next round, in groups of the same size, and so on for at most ``rounds`` rounds, so that the remainders of
    many groups end in few sequences. No group grows with the input: one that rows of equal id and text would make
    larger is split.

    Sequences are numbered round by round and group by group, with room for the largest group of the round, so no two
    share a number; order inside a sequence comes from hashes, so a rerun agrees (rows of equal id and text may
    change places). A null or empty text is the end id alone. Rows that repeat an id, or have none, are packed as
    documents of their own. A very long text is cut like any other. An empty table gives an empty result; extra
    columns, whatever their names, are ignored.
    """
    with arrow_batches(docs.sparkSession, BATCH_BYTES):
        found = pieces(docs, tokenizer, capacity, end_id, id_col, text_col)
        found = materialise(found.withColumn("row", F.monotonically_increasing_id()))
    names = "piece int, start long, length long, ids_crc32 long, row long, hash long, group long, seq long, offset long, fill long"
    shape = f"id {found.schema['id'].dataType.simpleString()}, {names}"
    zero = F.lit(0).cast("long")
    todo = found.withColumns({"hash": F.xxhash64("id", "piece"), "seq": zero, "offset": zero, "fill": zero})
    done, first = [], 0
    for k in range(rounds):
        dealt = _deal(todo, k, per_group).select([x.split()[0] for x in shape.split(", ")])
        packed = materialise(dealt.groupBy("group").applyInArrow(_pack_group(capacity), shape))
        last, most = packed.agg(F.coalesce(F.max("group"), F.lit(0)), F.coalesce(F.max("seq"), F.lit(0))).first()
        named = packed.withColumn("sequence_id", F.lit(first) + F.col("group") * F.lit(most + 1) + F.col("seq"))
        first += (last + 1) * (most + 1)
        if last == 0 or k == rounds - 1:
            done.append(named)
            break
        good = F.col("fill") >= good_fill * capacity
        done.append(named.where(good))
        todo = packed.where(~good).drop("group")
    out = done[0]
    for more in done[1:]:
        out = out.unionByName(more)
    return out.select(
        F.col("id").alias(id_col), "piece", "start", "length", "ids_crc32", "sequence_id", "offset"
    )
