"""Token counts by byte-pair merging with a heap and a linked list, without any ids.

Symbols form a linked list; a heap holds the adjacent pairs that make a piece, best score first. Each pop joins a
pair, so the count is the number of first symbols less the number of merges; a symbol that is no piece counts its
UTF-8 bytes. A text is first cut where no piece of the vocabulary holds the two characters at the border: no merge
can cross such a place, so counts add up, and those of short parts are kept in a bounded table.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame

from hearken.llm.common import small_batches, text_of

_SEGMENT = re.compile("▁+[^▁]*|[^▁]+")


class _Counts(dict):
    """Counts by text; holds `limit` texts, then starts anew, so memory is bounded and only speed varies."""

    def __init__(self, make, limit: int):
        self.make, self.limit = make, limit

    def __missing__(self, text: str) -> int:
        n = self.make(text)
        if len(text) <= 48:
            if len(self) >= self.limit:
                self.clear()
            self[text] = n
        return n


class PieceCounter:
    """Counts the tokens that a sentencepiece BPE model with byte fallback gives, without begin or end marks."""

    def __init__(self, path: str, cached: int = 250_000):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        plain = [i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]
        self.cost = {model.id_to_piece(i): -model.get_score(i) for i in plain}  # the lowest merges first
        self.borders = {p[k : k + 2] for p in self.cost for k in range(len(p) - 1)}
        self.parts = _Counts(self._merged, cached)
        self.segments = _Counts(self._segment, cached)

    def _merged(self, part: str) -> int:
        """First symbols less merges; one bad pair at the border of two symbols never blocks another."""
        cost, n = self.cost, len(part)
        piece = list(part)
        extra = [0 if c in cost else len(c.encode("utf-8")) - 1 for c in part]
        if n == 1:
            return 1 + extra[0]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(c, i, piece[i] + piece[i + 1]) for i in range(n - 1) if (c := cost.get(piece[i] + piece[i + 1])) is not None]
        heapq.heapify(heap)
        merges = 0
        while heap:
            _, i, whole = heapq.heappop(heap)
            if not piece[i] or (j := after[i]) >= n or piece[i] + piece[j] != whole:
                continue  # one of the two has been joined with another since
            piece[i], piece[j], extra[i], extra[j] = whole, "", 0, 0
            merges += 1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (c := cost.get(whole + piece[k])) is not None:
                    heapq.heappush(heap, (c, i, whole + piece[k]))
            if (h := before[i]) >= 0 and (c := cost.get(piece[h] + whole)) is not None:
                heapq.heappush(heap, (c, h, piece[h] + whole))
        return n - merges + sum(extra)

    def _segment(self, segment: str) -> int:
        total, start, borders, parts = 0, 0, self.borders, self.parts
        for k in range(1, len(segment)):
            if segment[k - 1 : k + 1] not in borders:
                total += parts[segment[start:k]]
                start = k
        return total + parts[segment[start:]]

    def count(self, text: str) -> int:
        if not text:
            return 0
        return sum(map(self.segments.__getitem__, _SEGMENT.findall("▁" + text.replace(" ", "▁"))))


_loaded: dict[str, PieceCounter] = {}


def piece_counter(path: str) -> PieceCounter:
    """The counter of a file; a Python worker keeps it from task to task."""
    if path not in _loaded:
        _loaded[path] = PieceCounter(path)
    return _loaded[path]


def count_tokens(docs: DataFrame, path: str, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of docs: the id, n_bytes, n_tokens, over_limit (n_tokens > limit).

    A null or empty text counts 0 bytes and 0 tokens; null ids and repeated rows are kept as they are; other
    columns are ignored. There is no shuffle.
    """
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = piece_counter(path)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            n = [counter.count(t) for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(t.encode("utf-8")) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([k > limit for k in n], pa.bool_())], [id_col, "n_bytes", "n_tokens", "over_limit"])

    return docs.select(id_col, text_of(text_col).alias("t")).mapInArrow(run, f"`{id_col}` {docs.schema[id_col].dataType.simpleString()}, n_bytes long, n_tokens long, over_limit boolean")
