"""Token counts of a sentencepiece BPE model by the whole-token shortcut.

Two facts about the vocabulary are proved once, before any text is read (`prove`):

* no piece has the word mark anywhere but in front, so no merge crosses from a character to a mark
  that follows it: a text's count is the sum of the counts of its chunks, a chunk being a run of
  marks and what follows up to the next mark;
* which pieces, standing as a whole chunk, encode to themselves alone. A chunk that is one of these
  counts 1 and is never merged.

A line feed has no piece of its own, so it and what follows it are counted apart as well. All other
chunks are merged by the library, each distinct one once while it is remembered; the memory is
bounded and forgets all at once, which costs time only.

Null and empty texts have 0 tokens. Long texts are read whole. Repeated rows count alike; other
columns aren't touched.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.store import by_text

MARK = "▁"
#: Chunks that a task remembers at most, and the longest that it remembers: some 100 MB together.
REMEMBERED = 500_000
LONGEST = 64
_CHUNK = re.compile("▁*[^▁\n]+|▁+|\n[^▁\n]*")


@dataclass
class Vocabulary:
    """What was proved offline. model: the file's bytes, some hundred kilobytes."""

    model: bytes
    whole: frozenset[str]
    splits: bool  # chunks may be counted apart
    feed: bool  # so may what begins with a line feed


def load(model: bytes):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_proto=model)


def prove(model: bytes) -> Vocabulary:
    """Check the vocabulary's pieces, one by one, with the library itself."""
    sp = load(model)
    pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
    normal = [p for i, p in enumerate(pieces) if not (sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i))]
    splits = all(MARK not in p.lstrip(MARK) for p in normal)
    # a mark may not join a mark over a chunk's end, and the dummy mark must be one of the chunk's
    splits = splits and sp.encode("a", out_type=str)[0].startswith(MARK) and sp.normalize("  a b ") == MARK * 3 + "a" + MARK + "b" + MARK
    feed = splits and all("\n" not in p for p in normal) and sp.normalize("a\nb") == MARK + "a\nb"
    starts = [p for p in normal if p.startswith(MARK) and len(p) > 1]
    encoded = sp.encode([p[1:].replace(MARK, " ") for p in starts], out_type=str)
    return Vocabulary(model, frozenset(p for p, e in zip(starts, encoded, strict=True) if e == [p]), splits, feed)


class Counter:
    """Counts texts; one a task. Chunks are known without their first mark, other marks as blanks."""

    def __init__(self, v: Vocabulary):
        self.v, self.sp = v, load(v.model)
        self._forget()

    def _forget(self) -> None:
        # the library drops a text of one mark, so that chunk is given
        self.known: dict[str, int] = {"": 1} | {p[1:].replace(MARK, " "): 1 for p in self.v.whole}

    def chunks(self, text: str) -> list[str]:
        if self.v.feed and text[:1] != " " and text[-1:] != " " and MARK not in text and "  " not in text and " \n" not in text:
            return text.replace("\n", " \n").split(" ")
        marked = MARK + text.replace(" ", MARK)
        found = _CHUNK.findall(marked) if self.v.feed else re.findall(f"{MARK}*[^{MARK}]+|{MARK}+", marked)
        return [c[1:].replace(MARK, " ") if c[0] == MARK else c for c in found]

    def _sizes(self, new: list[str]) -> list[int]:
        # what begins with a feed has the dummy mark as a token of its own
        return [len(ids) - (self.v.feed and c[0] == "\n") for c, ids in zip(new, self.sp.encode(new, num_threads=1), strict=True)]

    def _learn(self, new: list[str]) -> None:
        if len(self.known) > REMEMBERED:
            self._forget()
        self.known.update(zip(new, self._sizes(new), strict=True))

    def count(self, texts: list[str]) -> list[int]:
        if not self.v.splits:
            return [len(x) for x in self.sp.encode(texts, num_threads=1)]
        out = []
        for text in texts:
            if not text:
                out.append(0)
                continue
            chunks = self.chunks(text)
            known = self.known
            new = {c for c in chunks if c not in known}
            far = {c for c in new if len(c) > LONGEST}
            if new and len(new) > len(far):
                self._learn(list(new - far))
                if known is not self.known:
                    self._learn([c for c in set(chunks) - far if c not in self.known])
            if far:
                size = dict(zip(far, self._sizes(list(far)), strict=True))
                out.append(sum(size[c] if c in far else self.known[c] for c in chunks))
            else:
                out.append(sum(map(self.known.__getitem__, chunks)))
        return out


def count_tokens(docs: DataFrame, v: Vocabulary, limit: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens, over_limit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(v)
        for batch in batches:
            for lo in range(0, batch.num_rows, 256):
                part = batch.slice(lo, 256)
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(counter.count(texts), pa.int64())], names=[id_col, "n_bytes", "n_tokens"])

    schema = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("n_bytes", T.LongType()), T.StructField("n_tokens", T.LongType())])
    return by_text(docs.select(id_col, text_col)).mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)
