"""Vector bin packing of documents or examples into training sequences.

Every item carries a vector of three demands -- tokens, segments (1) and
loss-bearing tokens -- and a sequence has a limit on each.  The open sequence
takes, of the items waiting in the task, the one whose demand vector has the
largest dot product with what is left of the limits (both divided by the
limits), so an item that needs much of what is plentiful goes first.  When no
waiting item fits whole, the one with the largest dot product is cut at the
space that is left.  Runs of a full sequence leave a long item uncut otherwise.

Each task packs the rows it holds, with a bounded number of waiting items, so
there is no shuffle, a lost task is redone alone, and the padding is at most
one part-filled sequence a task (plus sequences that meet the segment limit).

Defined results: a null text is the empty text (its end token only); rows
repeated in the input are packed as often as they occur; an empty table gives
no rows; other columns of the input are ignored; a null id stays null.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession

from cohortforge.llm.arrow_text import slices, texts
from cohortforge.llm.word_tokens import encoder, load_definition, public_vocabulary

SEQUENCE_TOKENS = 2048
MAX_SEGMENTS = 256
END_ID = 1
# Items waiting in a task; more only means a better choice.
WAITING = 2048

PIECES = ("doc_id long, start long, length long, ids_crc32 long, doc_tokens long, "
          "sequence_id long, offset long, loss_tokens long")


class Packer:
    """Packs items of one task; ``rows`` collects (doc, start, length, crc, total, seq, offset, loss)."""

    def __init__(self, limits: tuple[int, int, int], first_sequence: int, waiting: int = WAITING,
                 splittable: bool = True):
        if min(limits) < 1:
            raise ValueError(f"a sequence that may hold nothing: {limits}")
        self.limits = np.asarray(limits, np.float64)
        self.tokens = limits[0]
        self.splittable = splittable
        self.waiting = waiting
        self.next_sequence = first_sequence
        self.demand = np.zeros((waiting, 3))
        self.free = list(range(waiting - 1, -1, -1))
        self.items: list[tuple | None] = [None] * waiting
        self.rows: list[tuple] = []
        self._open()

    def _open(self) -> None:
        self.left = self.limits.copy()
        self.sequence = self.next_sequence
        self.next_sequence += 1

    def _emit(self, item: tuple, sequence: int, offset: int) -> None:
        doc, start, ids, loss, total = item
        self.rows.append((doc, start, len(ids), zlib.crc32(ids.tobytes()), total, sequence, offset,
                          int(loss.sum())))

    def add(self, doc, ids: np.ndarray, loss: np.ndarray) -> None:
        """Queue one document; runs that fill a sequence on their own are placed at once."""
        n, at = len(ids), 0
        while n - at > 0:
            run = ids[at:at + self.tokens], loss[at:at + self.tokens]
            # a run that breaks the loss limit alone is cut where the limit is met
            over = np.flatnonzero(np.cumsum(run[1]) > self.limits[2])
            size = int(over[0]) if len(over) else len(run[0])
            size = max(size, 1)
            item = (doc, at, run[0][:size], run[1][:size], n)
            if size < n:        # a waiting part must not hold the whole document
                item = (doc, at, item[2].copy(), item[3].copy(), n)
            if size == self.tokens:
                self._emit(item, self.next_sequence, 0)
                self.next_sequence += 1
            else:
                while not self.free:
                    self._place()
                slot = self.free.pop()
                self.items[slot] = item
                self.demand[slot] = (size, 1, item[3].sum())
            at += size

    def _place(self) -> bool:
        """Put one waiting item (or a cut of one) into the open sequence; False if none waits."""
        used = self.demand[:, 1] > 0
        if not used.any():
            return False
        score = (self.demand / self.limits ** 2) @ self.left
        fits = used & (self.demand <= self.left).all(axis=1)
        offset = int(self.tokens - self.left[0])
        if fits.any():
            slot = int(np.argmax(np.where(fits, score, -1.0)))
            item = self.items[slot]
            self.items[slot] = None
            taken = self.demand[slot].copy()
            self.demand[slot] = 0
            self.free.append(slot)
        else:
            slot = int(np.argmax(np.where(used, score, -1.0)))
            doc, start, ids, loss, total = self.items[slot]
            room = int(min(self.left[0], len(ids)))
            over = np.flatnonzero(np.cumsum(loss[:room]) > self.left[2])
            room = int(over[0]) if len(over) else room
            if not self.splittable or room < 1 or self.left[1] < 1:
                self._open()
                return True
            item = (doc, start, ids[:room], loss[:room], total)
            rest = (doc, start + room, ids[room:], loss[room:], total)
            taken = np.array((room, 1, item[3].sum()), np.float64)
            self.items[slot] = rest
            self.demand[slot] = (len(rest[2]), 1, rest[3].sum())
        self._emit(item, self.sequence, offset)
        self.left = self.left - taken
        if self.left[0] < 1 or self.left[1] < 1:
            self._open()
        return True

    def finish(self) -> None:
        while self._place():
            pass

    def take(self) -> list[tuple]:
        rows, self.rows = self.rows, []
        return rows


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in PIECES.split(", ")]
    cols = zip(*rows) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], names=names)


def pack_texts(docs: DataFrame, definition: str, id_col: str = "doc_id", text_col: str = "text",
               tokens: int = SEQUENCE_TOKENS, max_segments: int = MAX_SEGMENTS,
               max_loss: int | None = None, end_id: int = END_ID) -> DataFrame:
    """One row per piece of every text: where it lies and the crc32 of its ids.

    ``loss_tokens``: ids of the piece that some id before them in the same
    document predicts, that is all but a document's first.
    """
    limits = (tokens, max_segments, tokens if max_loss is None else max_loss)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(definition)
        packer = Packer(limits, TaskContext.get().partitionId() << 36)
        for batch in batches:
            for part in slices(batch, "text"):
                offsets, ids = enc.encode(texts(part))
                for i, doc in enumerate(part.column("doc_id").to_pylist()):
                    own = np.append(ids[offsets[i]:offsets[i + 1]], np.uint32(end_id))
                    loss = np.ones(len(own), bool)
                    loss[0] = False
                    packer.add(doc, own, loss)
                yield _batch(packer.take())
        packer.finish()
        yield _batch(packer.take())

    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    return own.mapInArrow(pack, PIECES)


def pack_examples(examples: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", mask_col: str = "loss_mask",
                  tokens: int = SEQUENCE_TOKENS, max_segments: int = MAX_SEGMENTS, max_loss: int | None = None,
                  splittable: bool = False) -> DataFrame:
    """One row per piece of instruction examples that are token ids with a loss mask of their own.

    ``mask_col`` (array of booleans) says which ids bear loss: a null mask or
    element bears none, a shorter mask none beyond its end, what is longer than
    the ids is ignored.  Examples without ids give no piece.  An example that
    breaks a limit on its own is cut where it meets the limit, others stay whole
    unless ``splittable``.
    """
    limits = (tokens, max_segments, tokens if max_loss is None else max_loss)

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(limits, TaskContext.get().partitionId() << 36, splittable=splittable)
        for batch in batches:
            for doc, ids, mask in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "ids", "mask"))):
                own = np.array(ids or [], np.uint32)
                loss = np.zeros(len(own), bool)
                marks = np.array([bool(x) for x in (mask or [])[:len(own)]], bool)
                loss[:len(marks)] = marks
                packer.add(doc, own, loss)
            yield _batch(packer.take())
        packer.finish()
        yield _batch(packer.take())

    own = examples.select(examples[id_col].cast("long").alias("doc_id"), examples[ids_col].cast("array<long>").alias("ids"),
                          examples[mask_col].cast("array<boolean>").alias("mask"))
    return own.mapInArrow(pack, PIECES)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pack all documents into sequences of 2048 tokens."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return pack_texts(docs, load_definition(public_vocabulary()))
