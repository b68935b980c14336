"""Packing documents into sequences of a fixed number of tokens by bin completion.

Texts are tokenized once, in the map pass: a text is cut at single spaces behind other characters,
where the pattern always has a boundary, and each distinct word of a slice is encoded once. Ids are those of
the tokenizer's plain call: the text of one of its special tokens is that token. A document longer than the capacity is cut into whole pieces, the first of which may be shorter.

Pieces are dealt by a hash into groups of about GROUP documents, so every group is alike and bounded
whatever the corpus' size or order (rows without an id or with one id are dealt by what is in them), and each group is packed by itself: at most one sequence in a
group of thousands more than without groups. Within a group:

* best-fit decreasing gives the first incumbent;
* if it uses more bins than the lower bound, bin completion searches: around the largest piece left,
  the undominated fillings of the rest of its bin are enumerated, one at a time, when the search comes
  back for the next (a filling is dominated if a piece that it leaves out can take the place of some of
  its pieces or of its slack); a branch is pruned when the waste so far does not allow fewer bins than
  the incumbent;
* fillings come in this order: one piece that nearly fills the room (LITTLE), with what fits beside it;
  two pieces that fill it; best fit; then all by waste;
* the search ends at the lower bound or after NODES nodes, its only limit, and the best incumbent stands.

Null and empty texts are one end token. No document is dropped or cut otherwise. Equal rows are
packed as separate documents. Other columns are not read.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from corollary.llm.common import checkpoint, map_rows

CAPACITY = 1024
END = 2
GROUP = 8192
#: A single piece may waste so much and still be tried before fillings of several pieces.
LITTLE = 2
#: A group's search ends after this many nodes: pieces tried and fillings looked at.
NODES = 100_000
CACHE = 600_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


#: Byte-level BPE writes each byte as a letter: printable bytes as themselves, the others as the
#: characters from 256 on.
BYTE_LETTERS = {b: 256 + i for i, b in enumerate(b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or b >= 174))}
_MARKS = frozenset(",.;:!?")

# ---- tokens -------------------------------------------------------------------------------------


class WordTokenizer:
    """Ids of many texts at once. Texts are cut at single spaces behind other characters; Arrow tells a
    slice's distinct words, each of which is encoded once and kept for the next slices: ``row`` has its
    number, ``count`` how many ids it has, ``flat`` the ids of all words in order. Words are kept with the space before
    them. A word of letters alone is one match of the pattern, so it is merged by itself; other words
    are cut at the places where the pattern always has a boundary, and what is left goes to the
    tokenizer. A full table is emptied before the next slice."""

    _SEAM = re.compile(r"(?<=\S) ")
    #: White space (as ``\s`` has it) before a space, for RE2.
    _UNSURE = "[\t-\r\x1c-\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000] "
    #: More places where the pattern always has a boundary: a letter before ASCII punctuation or
    #: white space, and both sides of a line break between other characters.
    _INNER = re.compile(r"(?<=[A-Za-zÀ-ÖØ-öø-ɏ])(?=[\n -/:-@\[-`{-~])|(?<=\S)(?=\n)|(?<=\S\n)(?=\S)")
    _LETTERS = re.compile(r" ?[A-Za-zÀ-ÖØ-öø-ɏ]+")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.model = Tokenizer.from_file(path)
        self.merge = _merger(path)
        added = self.model.get_added_tokens_decoder()
        if any(t.lstrip or t.rstrip or t.single_word for t in added.values()):
            raise ValueError("a tokenizer whose added tokens take more than their own text")
        #: Texts that the tokenizer takes for one token wherever they stand, the longest first; what stands
        #: before and behind is encoded by itself.
        self.added = {t.content: i for i, t in sorted(added.items(), key=lambda x: -len(x[1].content))}
        marks = "|".join(map(re.escape, self.added))
        self.added_re = re.compile(f"({marks})") if marks else None
        self.by_hand = f"{self._UNSURE}|{marks}" if marks else self._UNSURE
        self.clear()

    def clear(self) -> None:
        self.row: dict[str, int] = {}
        self.flat, self.count = array("I", [END]), array("q", [1])  # row 0 is the end
        self._put(list(self.added), [[i] for i in self.added.values()])

    def _cut(self, text: str) -> tuple[list[str], list[int]]:
        """A text's words, and which of them have no space before them."""
        words, first = [], []
        for part in self.added_re.split(text) if self.added_re else [text]:
            if part or len(text) == 0:
                first.append(len(words))
                words += [part] if part in self.added else self._SEAM.split(part)
        return words, first

    def _put(self, words: list[str], ids: list) -> None:
        self.row.update(zip(words, range(len(self.count), len(self.count) + len(words))))
        self.count.extend(map(len, ids))
        self.flat.extend(chain.from_iterable(ids))

    def _whole(self, words: list[str]) -> list[str]:
        """Encode the words that are letters alone; the others."""
        plain = [w for w in words if self._LETTERS.fullmatch(w)] if self.merge else []
        self._put(plain, list(map(self.merge, map(str.encode, plain))))
        return [w for w in words if w not in self.row] if len(plain) < len(words) else []

    def _add(self, words: list[str]) -> None:
        mixed = self._whole(words)
        if not mixed:
            return
        # mostly letters with one mark behind them
        cut = [(w[:-1], w[-1]) if w[-1:] in _MARKS and w[-2:-1].isalpha() and self._LETTERS.fullmatch(w[:-1]) else self._INNER.split(w) for w in mixed]
        parts = list(dict.fromkeys(chain.from_iterable(cut)))
        other = self._whole([p for p in parts if p not in self.row])
        self._put(other, [e.ids for e in self.model.encode_batch_fast(other, add_special_tokens=False)])
        count = np.array(self.count)
        end = np.cumsum(count)
        at = np.fromiter(map(self.row.__getitem__, parts), np.int64, len(parts))
        ids_of = {p: self.flat[i:j] for p, i, j in zip(parts, (end - count)[at].tolist(), end[at].tolist())}
        several = [(w, c) for w, c in zip(mixed, cut) if len(c) > 1]
        self._put([w for w, _ in several], [list(chain.from_iterable(map(ids_of.__getitem__, c))) for _, c in several])

    def rows(self, words: list[str]) -> np.ndarray:
        missing = [w for w in dict.fromkeys(words) if w not in self.row]
        if missing:
            self._add(missing)
        return np.fromiter(map(self.row.__getitem__, words), np.int64, len(words))

    def encode(self, texts: list[str | None]) -> tuple[list[int], np.ndarray, np.ndarray]:
        """The texts' order in the result, their ids one behind another, each text's with END behind
        them, and where each text's begin (with one more at the end)."""
        if len(self.row) > CACHE:
            self.clear()
        whole = pa.array([t or "" for t in texts], pa.large_string())
        unsure = pa.compute.match_substring_regex(whole, self.by_hand)
        order = np.concatenate([np.flatnonzero(~np.asarray(unsure)), np.flatnonzero(np.asarray(unsure))]).tolist()
        split = pa.compute.split_pattern(whole.filter(pa.compute.invert(unsure)), " ")
        cut = [self._cut(t) for t in whole.filter(unsure).to_pylist()]
        by_hand = pa.array([words for words, _ in cut], split.type)
        words = pa.concat_arrays([split.flatten(), by_hand.flatten()]).dictionary_encode()
        size = np.concatenate([np.asarray(pa.compute.list_value_length(x)) for x in (split, by_hand)])
        begin = np.cumsum(size) - size
        sure = len(split)
        begin = np.concatenate([begin[:sure], *(b + np.array(first) for b, (_, first) in zip(begin[sure:], cut))]).astype(np.int64)
        distinct = words.dictionary.to_numpy(zero_copy_only=False).tolist()
        of_word = self.rows([f" {w}" for w in distinct])
        at = np.asarray(words.indices)
        place = of_word[at]
        place[begin] = self.rows([distinct[k] for k in at[begin].tolist()])  # no space before these
        place = np.insert(place, np.cumsum(size), 0)
        count, flat = np.array(self.count), np.array(self.flat, dtype="<u4")
        first = np.cumsum(count) - count
        n = count[place]
        end = np.cumsum(n)
        ids = flat[np.repeat(first[place] - (end - n), n) + np.arange(end[-1] if len(end) else 0)]
        edges = np.concatenate([[0], end[np.cumsum(size + 1) - 1]])
        return order, ids, edges


def _merger(path: str):
    """A function from the UTF-8 bytes of one match of the pattern to its ids, or None if the file's
    merges are not in the order of their ids, which the byte-pair merge by rank needs."""
    import json

    import tiktoken

    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    letters = {chr(BYTE_LETTERS.get(b, b)): b for b in range(256)}
    merged = [model["vocab"].get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    base = [model["vocab"].get(c) for c in letters]
    if None in merged or None in base or merged != sorted(set(merged)) or merged and max(base) > merged[0]:
        return None
    ranks = {bytes(letters[c] for c in token): i for token, i in model["vocab"].items() if all(c in letters for c in token) and (i in set(base) or merged[0] <= i <= merged[-1])} if len(merged) + len(base) == len(model["vocab"]) else None
    if ranks is None or model.get("ignore_merges") or model.get("dropout") or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix"):
        return None
    return tiktoken.Encoding("pieces", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def pieces(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32 (and ids as bytes if asked for)."""
    path = path or default_path()

    def rows(keys, texts):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        out = {k: [] for k in (id_col, "piece", "start", "length", "ids_crc32", *(["ids"] if keep_ids else []))}
        order, ids, begin = tokenizer(path).encode(texts)
        data = memoryview(ids.tobytes())
        for i, low, high in zip(order, begin.tolist(), begin[1:].tolist()):
            n = high - low
            edges = [0, *range(n % capacity or capacity, n + 1, capacity)]
            for k, (a, b) in enumerate(zip(edges, edges[1:])):
                part = data[4 * (low + a) : 4 * (low + b)]
                for name, v in zip(out, (keys[i], k, a, b - a, zlib.crc32(part), *([bytes(part)] if keep_ids else []))):
                    out[name].append(v)
        return out

    return map_rows(df.withColumn(id_col, F.col(id_col).cast("long")), [id_col, text_col], f"{id_col} long,piece int,start long,length long,ids_crc32 long" + (",ids binary" if keep_ids else ""), rows, by=text_col)


# ---- bins ---------------------------------------------------------------------------------------


def lower_bound(counts: Counter, capacity: int) -> int:
    """The larger of the sum bound and Martello and Toth's bound over all thresholds."""
    total = sum(s * n for s, n in counts.items())
    best = -(-total // capacity)
    sizes = sorted(counts, reverse=True)
    for k in sorted({s for s in sizes if 2 * s <= capacity} | {0}):
        big = sum(counts[s] for s in sizes if s > capacity - k)
        mid = [s for s in sizes if capacity - k >= s and 2 * s > capacity]
        n_mid = sum(counts[s] for s in mid)
        free = n_mid * capacity - sum(s * counts[s] for s in mid)
        small = sum(s * counts[s] for s in sizes if 2 * s <= capacity and s >= k)
        best = max(best, big + n_mid + max(0, -(-(small - free) // capacity)))
    return best


def best_fit(counts: Counter, capacity: int) -> list[list[int]]:
    """Best-fit decreasing over the sizes; bins by what is left are found in one bit mask."""
    bins: list[list[int]] = []
    by_rest: dict[int, list[int]] = {}
    mask = 0
    for size in sorted(counts, reverse=True):
        for _ in range(counts[size]):
            fit = mask >> size << size
            if fit:
                rest = (fit & -fit).bit_length() - 1
                k = by_rest[rest].pop()
                if not by_rest[rest]:
                    mask ^= 1 << rest
                bins[k].append(size)
            else:
                rest, k = capacity, len(bins)
                bins.append([size])
            rest -= size
            if rest not in by_rest or not by_rest[rest]:
                by_rest[rest] = []
                mask |= 1 << rest
            by_rest[rest].append(k)
    return bins


def _sums(filling: tuple[int, ...]) -> tuple[int, int]:
    """Bit masks of the sums of one piece or none, and of two pieces or more."""
    few, single, several = 1, 0, 0
    for s in filling:
        several |= (several | single) << s
        single |= 1 << s
    return few | single, several


def _smear(mask: int, low: int, high: int) -> int:
    """The mask moved up by each of low..high."""
    out, width = mask << low, 1
    while width <= high - low:
        step = min(width, high - low + 1 - width)
        out |= out << step
        width += step
    return out if high >= low else 0


def dominated(filling: tuple[int, ...], slack: int, counts: Counter, have: int) -> bool:
    """Whether a piece that the filling leaves out could take the place of some of its pieces (or of its
    slack): of one smaller piece, or of several that are no larger together, within the slack. What it
    takes the place of then fits into any place of that piece. have: bit mask of the sizes in counts."""
    for s in set(filling):
        if filling.count(s) >= counts[s]:
            have &= ~(1 << s)
    few, several = _sums(filling)
    return bool((_smear(few, 1, slack) | _smear(several, 0, slack)) & have)


def fillings(counts: Counter, room: int, waste: int, have: int | None = None, spend=lambda: True) -> Iterator[tuple[int, ...]]:
    """The undominated fillings of room that waste at most ``waste``, least waste first, one at a time.
    ``spend`` is called for each filling looked at and each piece tried; where it is false the
    enumeration ends. counts must be the same whenever the next filling is asked for."""
    if have is None:
        have = sum(1 << s for s, n in counts.items() if n > 0)
    have &= (2 << room) - 1
    # bit room - s for each size s: two sizes that sum to t are common bits of one mask and the other, moved
    back = int(f"{have:0{room + 1}b}"[::-1], 2)

    def exactly(left: int, largest: int, chosen: tuple[int, ...]) -> Iterator[tuple[int, ...]]:
        """Fillings whose further pieces are ``largest`` at most and sum to left: one piece, two pieces,
        the most alike first, then more."""
        if left <= largest and have >> left & 1 and chosen.count(left) < counts[left]:
            yield (*chosen, left)
        most = (2 << min(largest, left - 1)) - 1
        pairs = have & back >> (room - left) & most >> (left + 1) // 2 << (left + 1) // 2
        while pairs:
            a = (pairs & -pairs).bit_length() - 1
            pairs &= pairs - 1
            if not spend():
                return
            one = (*chosen, a)
            if chosen.count(a) < counts[a] and one.count(left - a) < counts[left - a]:
                yield (*one, left - a)
        first = have & most
        while first:
            a = first.bit_length() - 1
            first ^= 1 << a
            if 3 * a < left or not spend():
                return
            if chosen.count(a) < counts[a]:
                yield from (f for f in exactly(left - a, a, (*chosen, a)) if len(f) > len(chosen) + 2)

    if not have:
        if room <= waste:
            yield ()
        return
    def best_fitting(one: tuple[int, ...], left: int) -> tuple[int, ...]:
        """The filling with the largest piece that fits, again and again."""
        fits = have & (2 << left) - 1
        while fits:
            a = fits.bit_length() - 1
            k = min(left // a, counts[a] - one.count(a))
            one, left = one + (a,) * k, left - k * a
            fits &= (1 << min(a, left + 1)) - 1
        return one

    # first one piece that nearly fills the room, with what goes beside it: that leaves most for other
    # bins; then two pieces that fill it, then best fit; only then the others
    first = [(room - w,) for w in range(min(LITTLE, waste, room - 1) + 1) if have >> room - w & 1]
    tried = set()
    for f in chain((best_fitting(f, room - sum(f)) for f in first), takewhile(lambda f: len(f) == 2, exactly(room, room, ())), (best_fitting((), room),)):
        w = room - sum(f)
        if not spend():
            return
        if w <= waste and f not in tried and not dominated(f, w, counts, have):
            tried.add(f)
            yield f
            if not w and len(f) == 1:
                return  # any other filling fits into that one piece
    sums = None
    for w in range(min(waste, room) + 1):
        if w:
            if sums is None:  # the sums that there are at all
                sums = 1
                for s, n in counts.items():
                    k = 1
                    while n > 0 and s <= room:
                        sums |= sums << s * min(k, n) & (2 << room) - 1
                        n -= k
                        k *= 2
            if not sums >> room - w & 1:
                continue
        for f in exactly(room - w, room - w, ()) if w < room else [()]:
            if not spend():
                return
            if f not in tried and not dominated(f, w, counts, have):
                yield f


def complete(counts: Counter, capacity: int = CAPACITY, nodes: int = NODES) -> list[list[int]]:
    """Bins (lists of sizes) for a multiset of sizes, by bin completion from the best-fit incumbent."""
    counts = Counter({s: n for s, n in counts.items() if n > 0})
    whole = [[capacity]] * counts.pop(capacity, 0)
    return whole + _search(counts, capacity, nodes)


def _search(counts: Counter, capacity: int, nodes: int) -> list[list[int]]:
    best = best_fit(counts, capacity)
    bound = lower_bound(counts, capacity)
    total = sum(s * n for s, n in counts.items())
    budget = nodes
    # depth-first: a stack of (fillings still to try, the largest size, waste before this bin)
    rest, bins, stack, waste = Counter(counts), [], [], 0
    have = sum(1 << s for s in rest)

    def spend() -> bool:
        nonlocal budget
        budget -= 1
        return budget > 0

    def take(s: int) -> None:
        nonlocal have
        rest[s] -= 1
        if not rest[s]:
            have ^= 1 << s

    def give(s: int) -> None:
        nonlocal have
        if not rest[s]:
            have ^= 1 << s
        rest[s] += 1

    def descend() -> None:
        largest = have.bit_length() - 1
        take(largest)
        allowed = (len(best) - 1) * capacity - total - waste
        stack.append((fillings(rest, capacity - largest, allowed, have, spend) if allowed >= 0 else iter(()), largest, waste))
        bins.append([largest])

    if len(best) > bound:
        descend()
    while stack and len(best) > bound and spend():
        options, largest, before = stack[-1]
        for s in bins[-1][1:]:  # undo the filling tried last
            give(s)
        bins[-1] = [largest]
        choice = next(options, None)
        if choice is None:
            stack.pop()
            bins.pop()
            give(largest)
            continue
        for s in choice:
            take(s)
        bins[-1] = [largest, *choice]
        waste = before + capacity - largest - sum(choice)
        if not have:
            if len(bins) < len(best):
                best = [list(b) for b in bins]
            continue
        # the waste so far must allow fewer bins than the incumbent
        if waste <= (len(best) - 1) * capacity - total:
            descend()
    return best


def _pack_table(t: pa.Table, capacity: int, nodes: int) -> pa.Table:
    lengths = t.column("length").to_pylist()
    names = list(zip((-1 if x is None else x for x in t.column(0).to_pylist()), t.column("piece").to_pylist()))
    order = sorted(range(len(lengths)), key=names.__getitem__)
    waiting: dict[int, list[int]] = {}
    for i in reversed(order):
        waiting.setdefault(lengths[i], []).append(i)
    group = t.column("group")[0].as_py()
    sequence, offset = [0] * len(lengths), [0] * len(lengths)
    for k, sizes in enumerate(complete(Counter(lengths), capacity, nodes)):
        at = 0
        for s in sizes:
            i = waiting[s].pop()
            sequence[i], offset[i] = (group << 32) + k, at
            at += s
    return t.drop_columns(["group"]).append_column("sequence_id", pa.array(sequence, pa.int64())).append_column("offset", pa.array(offset, pa.int64()))


def packed(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str | None = None, capacity: int = CAPACITY, keep_ids: bool = False, group: int = GROUP, nodes: int = NODES) -> DataFrame:
    """One row per piece: id, piece, start, length, ids_crc32, (ids,) sequence_id, offset."""
    cut = checkpoint(pieces(df, id_col, text_col, path, capacity, keep_ids))  # texts are tokenized once, whatever is lost later
    groups = max(1, -(-cut.where("piece = 0").count() // group))
    cut = cut.withColumn("group", F.pmod(F.xxhash64(id_col, "piece", "length", "ids_crc32"), F.lit(groups)))
    out = f"{id_col} long,piece int,start long,length long,ids_crc32 long" + (",ids binary" if keep_ids else "") + ",sequence_id long,offset long"
    return cut.groupBy("group").applyInArrow(lambda t: _pack_table(t, capacity, nodes), out)
