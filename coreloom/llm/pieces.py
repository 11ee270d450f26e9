"""SentencePiece merge models: exact encoding by backtracking, and decoding.

The library runs a queue of merges over the whole text. Here a text is encoded the
other way round: walk it from the left, take the longest vocabulary piece that
starts at the position (an Aho-Corasick automaton gives them all in one pass), and keep it if it
is *compatible* with the piece before it, i.e. if re-merging the two pieces' own
characters gives back the same two pieces. If not, try the next shorter piece; when
none is left, step back one piece and mark the position as failed in a bitfield, so
that no position is tried twice. A sequence whose neighbours are all compatible is
the merge result, because the first merge across a border would also happen in that
pair alone.

Only the file's vocabulary and scores are used; the library itself does not encode.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq
import re
from collections.abc import Iterable, Iterator

from coreloom.llm.registry import query, table
from coreloom.llm.vocab import path

SPACE = "▁"
#: Memory of a worker: distinct chunks, and pairs of neighbours, that it remembers (twice over at most).
CACHED_CHUNKS = 500_000
CACHED_PAIRS = 150_000
#: Longer chunks (texts without spaces) are encoded afresh each time.
LONGEST_CACHED = 48


class _Cache(dict):
    """A dict that computes what it lacks; when full, it keeps only what is used again."""

    def __init__(self, compute, most: int, longest: int):
        super().__init__()
        self.compute, self.most, self.longest = compute, most, longest
        self.older: dict = {}

    def __missing__(self, key):
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        self.put(key, value)
        return value

    def put(self, key, value) -> None:
        if len(key) <= self.longest:
            if len(self) >= self.most:
                self.older = dict(self)
                self.clear()
            self[key] = value


def _replaced(error):
    return "�" * (error.end - error.start), error.end


codecs.register_error("coreloom-each-byte", _replaced)


class PieceCodec:
    """Encoder and decoder of one merge-type model file (identity normalizer, dummy prefix)."""

    def __init__(self, model_file: str):
        import ahocorasick
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model_file)
        self.bos, self.eos, self.unk = sp.bos_id(), sp.eos_id(), sp.unk_id()
        self.score: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.byte_ids = [self.unk] * 256
        self.surface: list[bytes] = []
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_ids[value] = i
                self.surface.append(bytes([value]))
            elif sp.is_control(i):
                self.surface.append(b"")
            elif sp.is_unknown(i):
                self.surface.append(" ⁇ ".encode())
            else:
                self.surface.append(piece.replace(SPACE, " ").encode())
                if not sp.is_unused(i):
                    self.ids[piece], self.score[piece] = i, sp.get_score(i)
        probe = "ﬁ Á  ①"
        if sp.normalize(probe) != SPACE + probe.replace(" ", SPACE):
            raise ValueError(f"{model_file} rewrites texts; only identity normalizers are supported")
        self.automaton = ahocorasick.Automaton()
        #: Pieces that their own characters merge into, and each one's next shorter prefix.
        whole = {p for p in self.ids if len(p) == 1 or self._merge(p) == [p]}
        self.shorter: dict[str, str | None] = {}
        for piece in whole:
            self.automaton.add_word(piece, piece)
            self.shorter[piece] = next((piece[:k] for k in range(len(piece) - 1, 0, -1) if piece[:k] in whole), None)
        self.automaton.make_automaton()
        self.raw = _Cache(self._piece_bytes, CACHED_PAIRS, 16)
        self.pairs = _Cache(self._compatible, CACHED_PAIRS, 2)
        self.chunks = _Cache(self._chunk_bytes, CACHED_CHUNKS, LONGEST_CACHED)
        self.pattern = self._chunk_pattern()

    def _chunk_pattern(self) -> re.Pattern:
        """Cuts a text only between characters that no piece has side by side.

        Cuts lie before a run of spaces, around a line feed, and between a letter or
        digit and a sign that never follows one inside a piece.
        """
        beside = {(p[i], p[i + 1]) for p in self.ids for i in range(len(p) - 1)}
        if any(a != SPACE and b == SPACE for a, b in beside) or any("\n" in pair for pair in beside):
            return re.compile(r"[\s\S]+")
        word = r"[^\W_]"
        after_word = {b for a, b in beside if re.fullmatch(word, a) and not re.fullmatch(word, b)}
        joins = "".join(map(re.escape, sorted(after_word)))
        sign = rf"(?:(?!{SPACE}|\n)[\W_])"
        more = rf"(?:{word}++[{joins}]{sign}*+)*+" if joins else ""
        return re.compile(rf"\n|(?=[^\n]){SPACE}*+{sign}*+{more}{word}*+")

    def _merge(self, text: str) -> list[str]:
        """The library's merge queue over a short text: best score first, then leftmost."""
        parts: list[str | None] = list(text)
        n = len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue: list = []

        def offer(i: int) -> None:
            j = after[i]
            if j < n and (score := self.score.get(parts[i] + parts[j])) is not None:
                heapq.heappush(queue, (-score, i, parts[i], parts[j]))

        for i in range(n):
            offer(i)
        while queue:
            _, i, left, right = heapq.heappop(queue)
            j = after[i]
            if parts[i] != left or j >= n or parts[j] != right:
                continue
            parts[i], parts[j] = left + right, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(i)
            if before[i] >= 0:
                offer(before[i])
        return [p for p in parts if p is not None]

    def _compatible(self, pair: tuple[str, str]) -> bool:
        return self._merge(pair[0] + pair[1]) == [*pair]

    def _pieces(self, text: str) -> list[str]:
        """Backtracking over one chunk; characters outside the vocabulary stand alone."""
        n, pairs = len(text), self.pairs
        greedy = [piece for _, piece in self.automaton.iter_long(text)]
        if sum(map(len, greedy)) == n and all(map(pairs.__getitem__, zip(greedy, greedy[1:]))):
            return greedy  # the walk below would never have to step back
        longest: dict[int, str] = {}
        for end, piece in self.automaton.iter(text):
            longest[end + 1 - len(piece)] = piece  # later ends are longer
        shorter = self.shorter
        taken: list[str] = []
        failed, at = 0, 0
        piece = longest.get(0) or text[0]
        while at < n:
            while piece is not None:
                end = at + len(piece)
                if not failed >> end & 1 and (not taken or pairs[(taken[-1], piece)]):
                    taken.append(piece)
                    at = end
                    piece = (longest.get(at) or text[at]) if at < n else None
                    break
                piece = shorter.get(piece)
            else:
                failed |= 1 << at
                piece = taken.pop()
                at -= len(piece)
                piece = shorter.get(piece)
        return taken

    def _piece_bytes(self, piece: str) -> bytes:
        known = self.ids.get(piece)
        ids = [known] if known is not None else [self.byte_ids[b] for b in piece.encode("utf-8")]
        return b"".join(i.to_bytes(4, "little") for i in ids)

    def _chunk_bytes(self, chunk: str) -> bytes:
        return b"".join(map(self.raw.__getitem__, self._pieces(chunk))) if chunk else b""

    def encode_bytes(self, text: str | None, begin: bool = True, end: bool = True) -> bytes:
        """Ids as little-endian unsigned 32-bit integers; null encodes like the empty text."""
        body = b""
        if text:
            marked = SPACE + text.replace(" ", SPACE)
            body = b"".join(map(self.chunks.__getitem__, self.pattern.findall(marked)))
        first = self.bos.to_bytes(4, "little") if begin else b""
        return first + body + (self.eos.to_bytes(4, "little") if end else b"")

    def encode(self, text: str | None, begin: bool = True, end: bool = True) -> list[int]:
        return memoryview(self.encode_bytes(text, begin, end)).cast("I").tolist()

    def decode(self, ids: Iterable[int]) -> str:
        """Control ids vanish, byte ids join into characters (each bad byte becomes U+FFFD)."""
        ids = list(ids)
        joined = b"".join(map(self.surface.__getitem__, ids))
        first = next((i for i in ids if self.surface[i]), None)
        if joined[:1] == b" " and first != self.byte_ids[32] and first != self.unk:
            joined = joined[1:]  # the dummy prefix
        return joined.decode("utf-8", "coreloom-each-byte")


_CODECS: dict[str, PieceCodec] = {}


def codec(model_file: str) -> PieceCodec:
    """One codec per worker and model."""
    if model_file not in _CODECS:
        _CODECS[model_file] = PieceCodec(model_file)
    return _CODECS[model_file]


def encode_column(batches: Iterator, model_file: str, text: int) -> Iterator:
    """For each Arrow batch: its columns, and ``ids`` (list of int) of the text column."""
    import numpy as np
    import pyarrow as pa

    own = codec(model_file)
    for batch in batches:
        parts = [own.encode_bytes(t) for t in batch.column(text).to_pylist()]
        ends = np.cumsum([0, *(len(p) // 4 for p in parts)], dtype=np.int64)
        flat = pa.array(np.frombuffer(b"".join(parts), dtype="<u4").astype(np.int32))
        ids = pa.LargeListArray.from_arrays(pa.array(ends), flat).cast(pa.list_(pa.int32()))
        yield pa.RecordBatch.from_arrays([*batch.columns, ids], [*batch.schema.names, "ids"])


def encode(df, model_file: str, text: str = "text", name: str = "ids"):
    """Attach ``name`` (array<int>): begin id, the text's ids, end id. Other columns stay.

    No shuffle, one pass; null and empty texts give begin and end alone. An input
    column called ``name`` is replaced.
    """
    from pyspark.sql import functions as F

    df = df.drop(name)
    at = df.columns.index(text)
    inner = "ids"
    kept = df.toDF(*[f"c{i}" for i in range(len(df.columns))])
    schema = ", ".join(f"c{i} {f.dataType.simpleString()}" for i, f in enumerate(df.schema.fields))
    out = kept.mapInArrow(lambda batches: encode_column(batches, model_file, at), f"{schema}, {inner} array<int>")
    return out.select(*[F.col(f"c{i}").alias(c) for i, c in enumerate(df.columns)], F.col(inner).alias(name))


def digest_batches(batches: Iterator, model_file: str) -> Iterator:
    """doc_id and text in; digests of the ids and of the text decoded from them out."""
    import pyarrow as pa

    own = codec(model_file)
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    for batch in batches:
        counts, encoded, decoded = [], [], []
        for text in batch.column(1):
            raw = own.encode_bytes(text.as_py())
            counts.append(len(raw) // 4)
            encoded.append(hashlib.sha256(raw).hexdigest())
            decoded.append(hashlib.sha256(own.decode(memoryview(raw).cast("I")).encode("utf-8")).hexdigest())
        columns = [batch.column(0).cast(pa.int64()), pa.array(counts, pa.int64()), pa.array(encoded), pa.array(decoded)]
        yield pa.RecordBatch.from_arrays(columns, names)


def digests(docs, model_file: str):
    """Per document: number of ids, and SHA-256 of the ids and of the decoded text.

    Every row of ``docs`` gives one row, also repeated or null ids; a null text counts
    as empty (begin and end ids only, decoded to the empty text). No shuffle.
    """
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
    return docs.select("doc_id", "text").mapInArrow(lambda batches: digest_batches(batches, model_file), schema)


@query("op1_sentencepiece")
def op1(spark, sf_dir):
    return digests(table(spark, sf_dir, "documents"), path("piece_bpe_32k.model"))
