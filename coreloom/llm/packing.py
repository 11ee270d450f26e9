"""Packing token pieces into sequences by cutting-stock column generation.

Documents become token ids and are cut into pieces of at most the capacity. The pieces' lengths, rounded up to a grain,
form a histogram of at most CAPACITY / GRAIN classes, which is all the driver ever sees. A pattern says how
many pieces of each class share a sequence. A linear program over patterns covers the histogram with the fewest
sequences; its columns are generated: a knapsack dynamic program over the classes' prices finds the pattern that
would improve it most, until none does. The solution is rounded down, the few sequences' worth of pieces
left over are packed first-fit decreasing, and every class's pieces, ranked in a hash order, are dealt
to the pattern's places. Ranks, places and offsets are computed by Spark over tables of any size.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from coreloom.llm.numbering import number
from coreloom.llm.pieces import _Cache
from coreloom.llm.registry import query, table
from coreloom.llm.vocab import path

CAPACITY = 4096
#: Piece lengths are rounded up to multiples of this for the histogram.
GRAIN = 16
END_ID = 2
#: Column generation runs to the optimum; it also ends if so many rounds in a row gain nothing that doubles can show.
STALLED = 2_000
CACHED_WORDS = 700_000
LONGEST_CACHED = 48
#: A sign that is a token of its own, put between words that are encoded together.
MARK = "\x01"
TOGETHER = 512
#: Characters of texts, and words, that are handled at a time.
CHARS_TOGETHER = 6_000_000
WORDS_TOGETHER = 1 << 15
#: Small letters that no step before the merges changes, alone or side by side: ASCII and Latin-1 ones.
LETTERS = "".join(map(chr, (*range(0x61, 0x7B), *range(0xDF, 0xF7), *range(0xF8, 0x100))))


class ChunkTokenizer:
    """Token ids of texts; words between spaces and line feeds are remembered.

    Only for tokenizers that drop white space and case before their merges, so that a text's ids are its
    words' ids, and those of an ASCII word are those of its small letters.
    """

    def __init__(self, tokenizer_file: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_file)
        one = self._ids("a b\nc").tolist()
        if one != [i for c in "abc" for i in self._ids(c).tolist()]:
            raise ValueError(f"{tokenizer_file} does not drop white space")
        letters = "".join(map(chr, range(0x21, 0x7F)))
        if self._ids(letters).tolist() != self._ids(letters.lower()).tolist() or self._ids("THE").tolist() != self._ids("the").tolist():
            raise ValueError(f"{tokenizer_file} does not drop case")
        self.words = _Cache(self._encode, CACHED_WORDS, LONGEST_CACHED)
        mark = self._ids(MARK)
        self.mark = mark[0] if len(mark) == 1 else None
        self.plain = re.compile(f"[{LETTERS}]+").fullmatch
        self.direct = self._direct(tokenizer_file)

    def _direct(self, tokenizer_file: str):
        """The same merges without the steps before them, for words of LETTERS in the bytes' own signs; None if they differ.

        Such a word's last token, and no other one, carries the sign of a word's end.
        """
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        direct = Tokenizer.from_file(tokenizer_file)
        suffix = getattr(direct.model, "end_of_word_suffix", None)
        if not suffix:
            return None
        signs = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.signs = {ord(letter): signs.pre_tokenize_str(letter)[0][0] for letter in LETTERS}
        direct.normalizer, direct.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.last = np.zeros(direct.get_vocab_size(), dtype=bool)
        self.last[[i for token, i in direct.get_vocab().items() if token.endswith(suffix)]] = True
        tried = [*LETTERS, LETTERS, LETTERS[::-1], "the", "straße", "naïveté"]
        ids = np.array(direct.encode(" ".join(w.translate(self.signs) for w in tried), add_special_tokens=False).ids)
        same = ids.tolist() == [i for w in tried for i in self._ids(w).tolist()]
        return direct if same and self.last[ids].sum() == len(tried) else None

    def _ids(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _encode(self, word: str) -> bytes:
        if not word:
            return b""
        core, tail = self._parts(word)
        if core != word:
            return self.words[core] + (self.words[tail] if tail else b"")
        return self._ids(word).tobytes()

    @staticmethod
    def _parts(word: str) -> tuple[str, str]:
        """A word and the comma or full stop behind it, which never share a token; ASCII words in lower case."""
        core, tail = (word[:-1], word[-1]) if word[-1] in ",." and word[-2:-1].isalpha() else (word, "")
        return (core.lower() if core.isascii() and "<|" not in core else core), tail

    def _learn(self, words: list[str]) -> None:
        """Encode different ``words`` that the cache's younger part lacks, many together.

        Words of LETTERS go straight to the merges. Others stand between marks: spaces keep words and marks apart in
        every step of the tokenizer. Words with the mark or a special token's beginning are left to :meth:`_encode`.
        """
        new, older = self.words, self.words.older
        cores = {self._parts(w)[0] for w in words if w and w not in older}
        cores = [c for c in cores if c not in new and c not in older]
        plain = list(filter(self.plain, cores)) if self.direct else []
        for at in range(0, len(plain), TOGETHER):
            some = plain[at : at + TOGETHER]
            ids = self.direct.encode(" ".join(some).translate(self.signs), add_special_tokens=False).ids
            self._remember(some, np.array(ids, dtype="<u4"), self.last, 0)
        if self.mark is None:
            return
        known = set(plain)
        mixed = [c for c in cores if c not in known and MARK not in c and "<|" not in c]
        for at in range(0, len(mixed), TOGETHER):
            some = mixed[at : at + TOGETHER]
            ids = self._ids(f" {MARK} ".join([*some, ""]))
            self._remember(some, ids, np.arange(self.mark + 1) == self.mark, 1)

    def _remember(self, words: list[str], ids: np.ndarray, closing: np.ndarray, drop: int) -> None:
        """Words whose ids lie side by side, each one's up to a closing id; ``drop`` closing ids do not belong to it."""
        raw = ids.tobytes()
        ends = np.flatnonzero(closing[np.minimum(ids, len(closing) - 1)] & (ids < len(closing))) + 1
        begin = 0
        for word, end in zip(words, (4 * ends).tolist(), strict=True):
            self.words.put(word, raw[begin : end - 4 * drop])
            begin = end

    def encode_column(self, texts) -> tuple[np.ndarray, np.ndarray]:
        """The ids of an Arrow column of texts in a row (unsigned 32-bit), and where each text's begin (one entry more than texts).

        Words are split and made distinct by Arrow; a batch's different words are looked up once, and the ids
        gathered by position.
        """
        import pyarrow.compute as pc

        spaced = pc.replace_substring(pc.fill_null(texts, ""), "\n", " ")
        split = pc.split_pattern(spaced, " ")
        sizes = np.r_[0, np.cumsum(split.value_lengths().to_numpy(zero_copy_only=False), dtype=np.int64)]
        coded = split.flatten().dictionary_encode()
        words = coded.dictionary.to_numpy(zero_copy_only=False).tolist()
        known = list(map(self.words.get, words))
        missing = [i for i, ids in enumerate(known) if ids is None]
        self._learn([words[i] for i in missing])
        for i in missing:
            known[i] = self.words[words[i]]
        lengths = np.fromiter(map(len, known), dtype=np.int32, count=len(known)) // 4
        flat = np.frombuffer(b"".join(known), dtype="<u4")
        starts = np.cumsum(lengths, dtype=np.int32) - lengths
        order = coded.indices.to_numpy(zero_copy_only=False)
        ends = np.r_[0, np.cumsum(lengths[order], dtype=np.int64)]
        out = np.empty(int(ends[-1]), dtype="<u4")
        for at in range(0, len(order), WORDS_TOGETHER):
            some = order[at : at + WORDS_TOGETHER]
            first, last = ends[at], ends[at + len(some)]
            shift = np.repeat(starts[some] - (ends[at : at + len(some)] - first).astype(np.int32), lengths[some])
            shift += np.arange(last - first, dtype=np.int32)
            np.take(flat, shift, out=out[first:last])
        return out, ends[sizes]

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Each text's ids as little-endian unsigned 32-bit integers."""
        import pyarrow as pa

        ids, ends = self.encode_column(pa.array(texts, pa.string()))
        return [ids[a:b].tobytes() for a, b in zip(ends[:-1], ends[1:])]

    def encode_bytes(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]


def portions(texts, most: int = CHARS_TOGETHER) -> Iterator[tuple[int, int]]:
    """Row ranges of an Arrow text column, each of about ``most`` bytes or one longer row."""
    import pyarrow.compute as pc

    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False), dtype=np.int64)
    at = 0
    while at < len(sizes):
        reached = sizes[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(sizes, reached + most, side="right")))
        yield at, to
        at = to


_TOKENIZERS: dict[str, ChunkTokenizer] = {}


def _tokenizer(tokenizer_file: str) -> ChunkTokenizer:
    if tokenizer_file not in _TOKENIZERS:
        _TOKENIZERS[tokenizer_file] = ChunkTokenizer(tokenizer_file)
    return _TOKENIZERS[tokenizer_file]


def cut(docs: DataFrame, tokenizer_file: str, capacity: int = CAPACITY, end_id: int = END_ID, ids: bool = True) -> DataFrame:
    """Pieces of at most ``capacity`` ids: ``doc_id, start, length, ids_crc32, doc_tokens`` and, if asked, ``ids``.

    A document is its ids and then ``end_id``; null and empty texts are the end id alone. Only documents longer than the
    capacity are cut, into full pieces and a rest. Repeated rows give repeated pieces.
    """
    import pyarrow as pa

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = _tokenizer(tokenizer_file)
        for batch in batches:
            for first, last in portions(batch.column(1)):
                docs_of = batch.column(0).slice(first, last - first)
                body, ends = own.encode_column(batch.column(1).slice(first, last - first))
                whole = np.insert(body, ends[1:], end_id)
                begins = ends + np.arange(len(ends))  # with each document's end id
                counts = np.diff(begins)
                pieces_of = -(-counts // capacity)
                of = np.repeat(np.arange(len(counts)), pieces_of)
                start = capacity * (np.arange(len(of)) - np.repeat(np.cumsum(pieces_of) - pieces_of, pieces_of))
                length = np.minimum(capacity, counts[of] - start)
                at = begins[of] + start
                raw = memoryview(whole).cast("B")
                digests = [zlib.crc32(raw[4 * a : 4 * (a + n)]) for a, n in zip(at.tolist(), length.tolist())]
                columns = [docs_of.take(pa.array(of)), *(pa.array(c, pa.int64()) for c in (start, length, digests, counts[of]))]
                names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
                if ids:
                    bounds = pa.array(np.r_[at, len(whole)], pa.int32())
                    columns.append(pa.ListArray.from_arrays(bounds, pa.array(whole.astype(np.int32))))
                    names.append("ids")
                yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return rows.mapInArrow(pieces, schema + (", ids array<int>" if ids else ""))


def knapsack(prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Best-priced pattern: how many of class i (size i + 1) to take within ``capacity``."""
    best = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        # values of taking class s first: prices[s] + best[room - s - 1]
        usable = min(room, len(prices))
        values = prices[:usable] + best[room - usable : room][::-1]
        s = int(np.argmax(values))
        best[room] = best[room - 1]
        if values[s] > best[room] + 1e-12:
            best[room], taken[room] = values[s], s
    pattern, room = np.zeros(len(prices), dtype=np.int64), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            pattern[taken[room]] += 1
            room -= taken[room] + 1
    return float(best[capacity]), pattern


def column_generation(demand: np.ndarray, stalled: int = STALLED) -> list[tuple[np.ndarray, float]]:
    """Patterns and how often to use each, covering ``demand`` (pieces per class) in the linear relaxation.

    Class i has size i + 1 and the capacity is the number of classes. Starts from one pattern per
    class, keeps the basis inverse and prices new columns with :func:`knapsack`, until none improves it. The steps see
    demands that differ by under a millionth from the given ones, so that no two amounts run out at once and no
    basis comes back; the amounts returned are those of the given demands.
    """
    capacity = len(demand)
    used = np.flatnonzero(demand)
    m = len(used)
    if not m:
        return []
    columns = np.zeros((m, m))
    np.fill_diagonal(columns, capacity // (used + 1))
    inverse = np.linalg.inv(columns)
    wanted = demand[used].astype(float)
    apart = wanted + 1e-7 * (1 + np.random.default_rng(0).random(m))
    amount = inverse @ apart
    step, best, idle = 0, np.inf, 0
    while idle < stalled:
        gained = amount.sum() < best * (1 - 1e-15)
        best, idle, step = min(best, amount.sum()), 0 if gained else idle + 1, step + 1
        prices = np.full(capacity, -1.0)
        prices[used] = inverse.sum(axis=0)
        value, pattern = knapsack(prices, capacity)
        if value <= 1 + 1e-7:
            break
        entering = pattern[used].astype(float)
        change = inverse @ entering
        ratios = np.where(change > 1e-9, amount / np.where(change > 1e-9, change, 1), np.inf)
        leave = int(np.argmin(ratios))
        move = ratios[leave]
        amount = np.maximum(amount - move * change, 0)
        amount[leave] = move
        columns[:, leave] = entering
        if step % 100 == 99:
            inverse = np.linalg.inv(columns)
            amount = np.maximum(inverse @ apart, 0)
            continue
        pivot = inverse[leave] / change[leave]
        inverse -= np.outer(change, pivot)
        inverse[leave] = pivot
    amount = np.maximum(np.linalg.solve(columns, wanted), 0)
    out = []
    for k in range(m):
        pattern = np.zeros(capacity, dtype=np.int64)
        pattern[used] = np.rint(columns[:, k]).astype(np.int64)
        out.append((pattern, float(amount[k])))
    return out


def plan(demand: list[int]) -> list[tuple[dict[int, int], int]]:
    """``({class: pieces per sequence}, sequences)``: patterns that use up ``demand`` exactly.

    Class c (1 to the number of classes) has size c. The linear program's amounts are rounded down; what is left,
    at most a sequence's worth per pattern, is packed first-fit decreasing.
    """
    capacity = len(demand)
    left = [int(d) for d in demand]
    out: list[tuple[dict[int, int], int]] = []
    for pattern, amount in column_generation(np.array(left, dtype=np.int64)):
        sizes = {int(i) + 1: int(pattern[i]) for i in np.flatnonzero(pattern)}
        times = min([int(amount + 1e-6), *(left[c - 1] // k for c, k in sizes.items())])
        if times > 0:
            out.append((sizes, times))
            for c, k in sizes.items():
                left[c - 1] -= k * times
    while any(left):
        rest, room = {}, capacity
        for c in range(capacity, 0, -1):
            if left[c - 1] and c <= room:
                rest[c] = min(left[c - 1], room // c)
                room -= c * rest[c]
        times = min(left[c - 1] // k for c, k in rest.items())
        out.append((rest, times))
        for c, k in rest.items():
            left[c - 1] -= k * times
    return out


def pack(pieces: DataFrame, capacity: int = CAPACITY, grain: int = GRAIN) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset`` (gapless from 0 within a sequence).

    ``pieces`` has ``length`` (1 to ``capacity``) and any other columns, which stay. Repeated rows are packed one by
    one; an empty table packs to nothing. The broadcast plan has at most (capacity / grain) classes.
    """
    given = [c for c in pieces.columns if c not in ("sequence_id", "offset")]
    names = [f"c{i}" for i in range(len(given))]  # inner columns begin with an underscore
    length = F.col(names[given.index("length")])
    pieces = pieces.select(*given).toDF(*names)
    classes = capacity // grain
    classed = pieces.select(*names, F.ceil(length / grain).cast("int").alias("_class"))
    ranked = number(classed, ["_class"], "_rank")
    histogram = dict(ranked.groupBy("_class").count().collect())  # at most ``classes`` rows
    if histogram and (min(histogram) < 1 or max(histogram) > classes):
        raise ValueError(f"piece lengths must lie between 1 and {capacity}")
    places: dict[int, list[tuple]] = {c: [] for c in histogram}
    used = dict.fromkeys(histogram, 0)
    sequence = 0
    for pattern, times in plan([histogram.get(c, 0) for c in range(1, classes + 1)]):
        slot = 0
        for c in sorted(pattern, reverse=True):
            places[c].append((used[c], used[c] + pattern[c] * times, pattern[c], sequence, slot))
            used[c] += pattern[c] * times
            slot += pattern[c]
        sequence += times
    table_of = pieces.sparkSession.createDataFrame(
        sorted(places.items()),
        "_class int, _places array<struct<first: bigint, last: bigint, each: bigint, sequence: bigint, slot: bigint>>",
    )
    placed = ranked.join(F.broadcast(table_of), "_class").withColumn(
        "_place", F.filter("_places", lambda p: (p["first"] <= F.col("_rank")) & (F.col("_rank") < p["last"]))[0]
    )
    within = F.col("_rank") - F.col("_place.first")
    seated = placed.select(
        *names,
        (F.col("_place.sequence") + F.floor(within / F.col("_place.each"))).cast("bigint").alias("sequence_id"),
        (F.col("_place.slot") + within % F.col("_place.each")).alias("_slot"),
    )
    before = Window.partitionBy("sequence_id").orderBy("_slot").rowsBetween(Window.unboundedPreceding, -1)
    offset = F.coalesce(F.sum(length).over(before), F.lit(0)).cast("bigint")
    return seated.select(*[F.col(n).alias(g) for n, g in zip(names, given)], "sequence_id", offset.alias("offset"))


def packed(docs: DataFrame, tokenizer_file: str) -> DataFrame:
    """Every document's pieces with their places (digests instead of ids)."""
    pieces = pack(cut(docs, tokenizer_file, ids=False))
    return pieces.select(
        "doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"
    )


@query("op10_cutting_stock_packing")
def op10(spark, sf_dir):
    return packed(table(spark, sf_dir, "documents"), path("word_bpe_49k.json"))
