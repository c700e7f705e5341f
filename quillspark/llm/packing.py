"""Packing documents into windows of tokens by order-preserving dynamic programming.

The tokens of a task's rows, in their order, are one stream; each document ends with one more id. The
stream is cut into windows of `size` tokens at most. Cuts may stand at the ends of documents (free), at
the ends of sentences (SENTENCE tokens each) and, where a sentence is longer than LONGEST tokens, at
every LONGEST-th token of it (MIDDLE each). A window costs the tokens that it is padded by: to `size`,
or none where its length is a power of two. With f(j) the least cost of all up to cut j,

    f(j) = cost(j) + min( min over i within `size` of f(i) + position(i) + size - position(j),
                          min over i at a distance of a power of two of f(i) ).

The first minimum runs over a window that only moves on, so a monotone queue gives it at constant cost
a cut; the second asks for a few cuts by place. The stream is worked off in blocks of BLOCK tokens:
all windows of a block but the last few are settled, and those are cut anew with the next block. Only a
task's last window is cut by need.

Nothing is shuffled, and a task holds a block and its largest document. Windows of a power of two count
as full from LEAST tokens on.

Null texts count as empty: a document of the end id alone. Long texts are cut like others. Repeated rows
are documents of their own. Other columns aren't touched. An empty table gives no piece. The numbers of
sequences follow the order of the rows within a task and differ between ways to split the table.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quillspark.llm.store import by_text

SIZE = 1024
#: What a cut within a document costs, in tokens of padding: at the end of a sentence, elsewhere.
SENTENCE, MIDDLE = 2, 8
#: Tokens without the end of a sentence after which a cut is allowed.
LONGEST = 16
#: Tokens of a block, and how many of its last windows are cut anew with the next.
BLOCK, KEPT = 1 << 16, 4
#: Least window that isn't padded.
LEAST = 512
#: Where the byte-level pre-tokenizer splits a text: fixed values of this kind of vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def _bytes() -> dict[str, int]:
    """The character that stands for each byte in such a vocabulary: itself if printable, else one from 256 on."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in own)}


class Encoder:
    """Token ids of texts; one a task.

    Where the vocabulary is proved to be a plain byte-level one (the pattern above, merges in the order of
    their ids, no other option set), a faster library works out the same ids from the same merges; texts
    that it refuses, and all other vocabularies, are left to the library of the file.
    """

    def __init__(self, model: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(model)
        self.fast = self._proved(json.loads(model))
        vocabulary = self.tokenizer.get_vocab()
        self.blank = np.zeros(max(vocabulary.values()) + 1, bool)
        self.stop, self.feed = self.blank.copy(), self.blank.copy()
        for token, i in vocabulary.items():
            self.blank[i] = token[0] in "ĠĊ"
            self.stop[i] = token[-1] in ".!?"
            self.feed[i] = token[-1] == "Ċ"

    @staticmethod
    def _proved(spec: dict):
        model, before, added = spec["model"], spec.get("pre_tokenizer") or {}, spec.get("added_tokens", [])
        plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges"))
        plain = plain and before.get("type") == "ByteLevel" and before.get("use_regex", True) and not before.get("add_prefix_space") and not any(spec.get(k) for k in ("normalizer", "post_processor", "truncation", "padding"))
        plain = plain and all(not any(t[k] for k in ("single_word", "lstrip", "rstrip", "normalized")) for t in added)
        if not plain:
            return None
        special, byte = {t["content"]: t["id"] for t in added}, _bytes()
        if any(c not in byte for k in model["vocab"] if k not in special for c in k):
            return None
        ranks = {bytes(byte[c] for c in k): i for k, i in model["vocab"].items() if k not in special}
        merged = [model["vocab"].get("".join(m.split(" ") if isinstance(m, str) else m)) for m in model["merges"]]
        if None in merged or merged != sorted(merged) or len(set(merged)) + 256 != len(ranks):
            return None
        import tiktoken

        return tiktoken.Encoding("packing", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special)

    def encode(self, text: str) -> np.ndarray:
        if self.fast is not None:
            try:
                return self.fast.encode_to_numpy(text, allowed_special="all")
            except ValueError:  # endless white space
                pass
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def ends_of_sentences(self, ids: np.ndarray) -> np.ndarray:
        """Whether a sentence ends behind each id: after a stop that a blank follows, after a line feed."""
        after = np.zeros(len(ids), bool)
        after[:-1] = self.stop[ids[:-1]] & self.blank[ids[1:]]
        return after | self.feed[ids]


def candidates(ends: np.ndarray, sentences: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, costs) of the cuts of a stream that begins at 0: ends of documents, of sentences, and within long sentences."""
    places = np.unique(np.concatenate([[0], ends, sentences]))
    gaps = np.diff(places)
    far = np.flatnonzero(gaps > LONGEST)
    inner = [places[k] + np.arange(LONGEST, gaps[k], LONGEST) for k in far]
    inner = np.concatenate(inner) if inner else np.zeros(0, np.int64)
    cost = np.where(np.isin(places, ends), 0, SENTENCE)
    every, costs = np.concatenate([places, inner]), np.concatenate([cost, np.full(len(inner), MIDDLE)])
    order = np.argsort(every, kind="stable")
    costs = costs[order]
    costs[0] = 0
    return every[order], costs


def cuts(places: np.ndarray, costs: np.ndarray, size: int = SIZE) -> list[int]:
    """Indices of the cuts of least cost, the first and the last place included; no gap of places is over size."""
    n = len(places)
    into: dict[int, list[int]] = {}
    k = LEAST
    while k < size:
        i = np.searchsorted(places, places - k)
        hit = np.flatnonzero(places[i] == places - k)
        for j, before in zip(hit.tolist(), i[hit].tolist(), strict=True):
            into.setdefault(j, []).append(before)
        k *= 2
    place, cost = places.tolist(), costs.tolist()
    f, source = [0] * n, [0] * n  # f: the least cost, and the place
    queue, head = [0], 0
    for j in range(1, n):
        p = place[j]
        while place[queue[head]] < p - size:
            head += 1
        i = queue[head]
        best = f[i] + size  # of f(i) + position(i) + size
        if j in into:
            for k in into[j]:
                if f[k] - place[k] + p <= best:
                    best, i = f[k] - place[k] + p, k
        best += cost[j]
        f[j], source[j] = best, i
        while len(queue) > head and f[queue[-1]] >= best:
            queue.pop()
        queue.append(j)
    path = [n - 1]
    while path[-1]:
        path.append(source[path[-1]])
    return path[::-1]


class Stream:
    """The open documents of a task: (id, tokens of it before, all tokens of it), their ids, and the sequences so far."""

    def __init__(self, encoder: Encoder, first: int, size: int):
        self.encoder, self.sequence, self.size = encoder, first, size
        self.rows: list = []
        self.done: list[int] = []
        self.whole: list[int] = []
        self.ids: list[np.ndarray] = []
        self.held = 0

    def add(self, row, ids: np.ndarray) -> None:
        self.rows.append(row)
        self.done.append(0)
        self.whole.append(len(ids))
        self.ids.append(ids)
        self.held += len(ids)

    def settle(self, last: bool) -> dict[str, list]:
        """The pieces of all settled windows; what is left stays open."""
        ids = np.concatenate(self.ids)
        ends = np.cumsum([len(x) for x in self.ids])
        sentences = np.flatnonzero(self.encoder.ends_of_sentences(ids)) + 1
        places, costs = candidates(ends, sentences[sentences < ends[-1]])
        at = places[cuts(places, costs, self.size)]
        if not last:
            at = at[: max(1, len(at) - KEPT)]
        edges = np.unique(np.concatenate([at, ends[ends < at[-1]]]))
        start, stop = edges[:-1], edges[1:]
        doc = np.searchsorted(ends, start, "right")
        window = np.searchsorted(at, start, "right") - 1
        begins = ends - np.array([len(x) for x in self.ids])
        done = np.array(self.done)
        out = {
            "row": [self.rows[d] for d in doc.tolist()],
            "start": (start - begins[doc] + done[doc]).tolist(),
            "length": (stop - start).tolist(),
            "ids": [ids[a:b].astype("<u4").tobytes() for a, b in zip(start.tolist(), stop.tolist(), strict=True)],
            "doc_tokens": np.array(self.whole)[doc].tolist(),
            "sequence_id": (self.sequence + window).tolist(),
            "offset": (start - at[window]).tolist(),
        }
        self.sequence += len(at) - 1
        left = int(np.searchsorted(ends, at[-1], "right"))
        if left < len(self.rows):
            cut = int(at[-1] - begins[left])
            self.ids[left], self.done[left] = self.ids[left][cut:], self.done[left] + cut
        self.rows, self.done, self.whole, self.ids = self.rows[left:], self.done[left:], self.whole[left:], self.ids[left:]
        self.held = int(ends[-1] - at[-1])
        return out


def pack(docs: DataFrame, model: str, end_id: int = 0, size: int = SIZE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, start, length, ids, doc_tokens, sequence_id, offset) of every piece; ids: unsigned 32-bit, little-endian.

    model: the JSON of a byte-level tokenizer; size: a power of two.
    """
    if size < 2 * LONGEST or size & (size - 1):
        raise ValueError(f"size must be a power of two of at least {2 * LONGEST}")
    if id_col in ("start", "length", "ids", "doc_tokens", "sequence_id", "offset"):
        raise ValueError(f"the result has a column {id_col} of its own; rename the id")
    kind = docs.schema[id_col].dataType
    schema = T.StructType([T.StructField(id_col, kind), *(T.StructField(c, T.LongType()) for c in ("start", "length")), T.StructField("ids", T.BinaryType()), *(T.StructField(c, T.LongType()) for c in ("doc_tokens", "sequence_id", "offset"))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        stream, arrow = Stream(Encoder(model), 0, size), None

        def settled(last: bool) -> pa.RecordBatch:
            out = stream.settle(last)
            return pa.RecordBatch.from_arrays([pa.array(v, arrow if k == "row" else pa.binary() if k == "ids" else pa.int64()) for k, v in out.items()], names=schema.names)

        for batch in batches:
            if arrow is None and batch.num_rows:
                arrow = batch.schema.field(0).type
                stream.sequence = batch.column(2)[0].as_py() << 40
            for row, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                stream.add(row, np.append(stream.encoder.encode(text.as_py() or ""), np.uint32(end_id)))
                if stream.held >= BLOCK:
                    yield settled(False)
        if stream.held:
            yield settled(True)

    return by_text(docs.select(id_col, text_col, F.spark_partition_id().alias("_part"))).mapInArrow(run, schema)
