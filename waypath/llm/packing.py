"""Sum-of-squares online packing of token ids into sequences of at most `window` tokens.

Every document is tokenised once; whole windows are cut off its front, and what is left goes to the fill level that
minimises the sum over levels of (number of partially filled sequences at that level) squared. The counts sit in an
array of `LEVELS` cells, so a placement looks at the levels only. A sequence that lacks less than one level's width is
topped up with the first tokens of the next piece (documents may be cut), so that few stay open. Each task packs its
own rows. At a task's end the sequences filled most stay as they are and take what they lack from the emptiest; the
last tokens, less than a window, become sequences whose lengths are powers of two, which are not padded. So nothing is
padded, at the cost of at most log2(window) short sequences a task.

Defined cases: a null text counts as empty and still has its closing id; a null id is packed like any other; repeated
documents are packed each; ties between levels go to the fullest; an empty table gives no rows; other columns are
ignored. Very long texts are held as ids once; a text with a run of LONG_RUN signs of white space or more goes to the
named library, as the faster one recurses on such runs.
"""

from __future__ import annotations

import base64
import re
import zlib
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from waypath.llm.common import bounded_batches, documents, give_back

WINDOW = 1024
#: Fill levels, of which a sequence has one.
LEVELS = 32
#: White space on end, beyond which the faster library, which recurses on it, is not used.
LONG_RUN = 4096
#: Texts of these characters get the same ids from both libraries (tested); others go to the slower one.
_COMMON = re.compile("[^\x00-ɏ]")
_LONG_RUN = re.compile(rf"\s{{{LONG_RUN}}}")
_SPECIAL = "<|endoftext|>"
_ENCODERS: dict[tuple[str, str], Callable[[str], list[int]]] = {}


def encoder(vocabulary: str | None = None, ranks: str | None = None) -> Callable[[str], list[int]]:
    """Text to ids of the byte-level vocabulary; paths default to the public files."""
    import public_tokenizers

    key = (vocabulary or public_tokenizers.path("byte_bpe_50k.json"), ranks or public_tokenizers.path("byte_bpe_50k.tiktoken"))
    if key not in _ENCODERS:
        import tiktoken

        with open(key[1], "rb") as f:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        fast = tiktoken.Encoding("byte_bpe_50k", pat_str=public_tokenizers.PATTERN, mergeable_ranks=merges, special_tokens={})

        slow = []

        def encode(text: str) -> list[int]:
            if _COMMON.search(text) or _SPECIAL in text or len(text) >= LONG_RUN and _LONG_RUN.search(text):
                if not slow:
                    from tokenizers import Tokenizer

                    slow.append(Tokenizer.from_file(key[0]))
                    slow[0].encode_special_tokens = True
                return slow[0].encode(text, add_special_tokens=False).ids
            return fast.encode_ordinary(text)

        _ENCODERS[key] = encode
    return _ENCODERS[key]


Piece = tuple  # document, start, ids, tokens of the document


class SumOfSquares:
    """Open sequences by fill level. placed: tokens whose sequence the levels chose; moved: those that finish() moved."""

    def __init__(self, window: int = WINDOW, first_id: int = 0, levels: int = LEVELS):
        self.window, self.next_id = window, first_id
        self.width = max(1, window // levels)  # of a level
        self.count = [0] * (window // self.width + 1)
        self.open: list[list[tuple[int, int, list[Piece]]]] = [[] for _ in self.count]  # fill, number, pieces
        self.nearly: list[tuple[int, int, list[Piece]]] = []
        self.placed = self.moved = 0

    def level_for(self, size: int) -> int:
        """The level, -1 for a new sequence, whose change lowers the sum of squares most; the fullest among equals."""
        best, chosen = 2 * self.count[size // self.width] + 1, -1
        for k, n in enumerate(self.count):
            if not n or self.open[k][-1][0] + size > self.window:
                continue
            fill = self.open[k][-1][0] + size
            to = fill // self.width
            cost = 0 if to == k else 1 - 2 * n + (0 if self.window - fill < self.width else 2 * self.count[to] + 1)
            if cost <= best:
                best, chosen = cost, k
        return chosen

    def place(self, piece: Piece) -> list[tuple]:
        """The rows of the sequences that this piece completes."""
        out: list[tuple] = []
        doc, start, ids, total = piece
        self.placed += len(ids)
        while self.nearly and len(ids) > (lack := self.window - self.nearly[-1][0]):
            _, number, pieces = self.nearly.pop()
            out += rows_of(number, [*pieces, (doc, start, ids[:lack], total)])
            start, ids = start + lack, ids[lack:]
        size, k = len(ids), self.level_for(len(ids))
        fill, number, pieces = self.open[k].pop() if k >= 0 else (0, self.next_id, [])
        if k >= 0:
            self.count[k] -= 1
        else:
            self.next_id += 1
        fill, pieces = fill + size, [*pieces, (doc, start, ids, total)]
        if fill == self.window:
            return out + rows_of(number, pieces)
        if self.window - fill < self.width:
            self.nearly.append((fill, number, pieces))
        else:
            self.open[fill // self.width].append((fill, number, pieces))
            self.count[fill // self.width] += 1
        return out

    def finish(self) -> list[tuple]:
        """Fills the fullest open sequences from the emptiest; the rest becomes sequences of powers of two."""
        rest = deque(sorted([*self.nearly, *(x for level in self.open for x in level)], key=lambda x: (-x[0], x[1])))
        self.nearly, self.open, self.count = [], [[] for _ in self.count], [0] * len(self.count)
        out: list[tuple] = []
        spare: deque[Piece] = deque()
        numbers: list[int] = []

        def taken(size: int) -> list[Piece]:
            held = []
            while size:
                if not spare:
                    _, number, pieces = rest.pop()
                    numbers.append(number)
                    spare.extend(pieces)
                doc, start, ids, total = spare.popleft()
                if len(ids) > size:
                    spare.appendleft((doc, start + size, ids[size:], total))
                held.append((doc, start, ids[:size], total))
                size -= len(held[-1][2])
            return held

        left = sum(x[0] for x in rest)
        while left >= self.window:
            fill, number, pieces = rest.popleft() if rest else (0, numbers.pop(), [])
            lack = self.window - fill
            self.moved += lack
            out += rows_of(number, pieces + taken(lack))
            left -= self.window
        self.moved += left
        while left:
            size = 1 << (left.bit_length() - 1)
            held = taken(size)
            if not numbers:
                numbers.append(self.next_id)
                self.next_id += 1
            out += rows_of(numbers.pop(), held)
            left -= size
        return out


def rows_of(number: int, pieces: list[tuple]) -> list[tuple]:
    out, at = [], 0
    for doc, start, ids, total in pieces:
        out.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, number, at))
        at += len(ids)
    return out


_FIELDS = ("start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def pack(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, vocabulary: str | None = None, ranks: str | None = None, end_id: int = 0
) -> DataFrame:
    """One row a piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. No shuffle.

    A sequence's id holds its task in the high bits, so tasks number alike whichever executor runs them.
    """
    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType)] + [T.StructField(c, T.LongType()) for c in _FIELDS])
    arrow = to_arrow_schema(schema)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, type=arrow.field(i).type) for i, c in enumerate(zip(*rows))], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(vocabulary, ranks)
        levels = SumOfSquares(window, TaskContext.get().partitionId() << 40)
        rows: list[tuple] = []
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                ids = np.array([*encode(text or ""), end_id], dtype="<u4")
                n = len(ids)
                for at in range(0, n - n % window, window):
                    rows += rows_of(levels.next_id, [(doc, at, ids[at : at + window], n)])
                    levels.next_id += 1
                if n % window:
                    rows += levels.place((doc, n - n % window, ids[n - n % window :], n))
                if len(rows) >= 20_000:
                    yield batch(rows)
                    rows = []
        rows += levels.finish()
        if rows:
            yield batch(rows)
        give_back()

    bounded_batches(docs.sparkSession)
    return docs.select(F.col(f"`{id_col}`"), F.col(f"`{text_col}`").cast("string")).mapInArrow(run, schema)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = pack(documents(spark, sf_dir))
    return out.withColumn("doc_id", F.col("doc_id").cast("long"))
