"""Best-fit packing of documents into sequences of a fixed number of tokens.

Each task tokenises the documents it reads and packs them there and then, by online best fit over a bounded space: at most
OPEN bins are open, kept in stacks by free space, and a bitset of free spaces gives the tightest bin that a piece fits. A
full bin closes; if too many are open, the fullest closes. Pieces wait in a window of at most WINDOW bytes and are placed
longest first, which leaves few bins part-filled. Nothing is shuffled, no task sees another's rows, and a task's memory is
bounded by its bins, its window and its cache of chunks. A task that runs again on the same split gives the same sequences.

Text between two spaces that each stand alone begins a token of its own, so such chunks are tokenised once per worker and
kept, up to CACHE of them; texts with other white space around spaces go to the tokenizer whole.

A document is its ids, then SEPARATOR. Only documents longer than a sequence are cut: pieces of the full length, of which
the first may be shorter. Defined results: a null or empty text is the separator alone; repeated rows are packed as
often as they come; null ids are ids like any other; an empty table gives an empty table; other columns are not read.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

LENGTH = 2048
SEPARATOR = 0
#: Bins that a task keeps open.
OPEN = 16_384
#: Bytes of ids that wait in a task to be placed longest first.
WINDOW = 48 << 20
#: Chunks whose ids a worker keeps, and their longest.
CACHE, LONGEST = 300_000, 40
#: Marks that end a token when they follow a letter and close a chunk.
CLOSING = frozenset(".,;:!?")
#: White space that the tokenizer's own rules must judge: all but spaces and line ends.
OTHER_SPACE = re.compile(r"[^\S \n]")


# How byte-level tokenizers cut text into pieces, and the characters that stand for bytes in their vocabularies.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]


def _ranked(tokenizer) -> object | None:
    """The same vocabulary as ranks, for a quicker library, if ids follow the order of merges and nothing else touches the text."""
    import tiktoken

    spec = json.loads(tokenizer.to_str())
    model, cut = spec["model"], spec["pre_tokenizer"] or {}
    plain = spec["normalizer"] is None and cut.get("type") == "ByteLevel" and cut.get("use_regex") and not cut.get("add_prefix_space") and model["type"] == "BPE" and not model.get("dropout")
    special = {t["content"] for t in spec["added_tokens"]}
    vocab = {t: n for t, n in model["vocab"].items() if t not in special}
    merged = [vocab.get("".join(m.split(" ") if isinstance(m, str) else m), -1) for m in model["merges"]]
    if not plain or len(merged) + 256 != len(vocab) or any(a >= b for a, b in zip(merged, merged[1:])):
        return None
    rest = [b for b in range(256) if b not in PRINTED]
    byte = {chr(b): b for b in PRINTED} | {chr(256 + i): b for i, b in enumerate(rest)}
    return tiktoken.Encoding("ranked", pat_str=PIECES, mergeable_ranks={bytes(byte[c] for c in t): n for t, n in vocab.items()}, special_tokens={})


class Tokens:
    """Token ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.ranked = _ranked(self.tokenizer)
        self.after: dict[str, bytes] = {}  # chunks that follow a space
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.special = re.compile("|".join(special)) if special else None
        self.marks = dict(zip(CLOSING, self.encode(list(CLOSING))))

    def encode(self, texts: list[str]) -> list[bytes]:
        if self.ranked is None or (self.special and any(map(self.special.search, texts))):
            return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]
        encode = self.ranked.encode_ordinary
        return [array("I", encode(t)).tobytes() for t in texts]

    def _even(self, t: str) -> bool:
        """Whether every space of the text stands alone between two other characters that are no white space."""
        if "  " in t or " \n" in t or "\n " in t or t[:1] == " " or t[-1:] == " ":
            return False
        return not OTHER_SPACE.search(t) and not (self.special and self.special.search(t))

    def of(self, texts: list[str]) -> list[bytes]:
        chunks = [t.split(" ") if self._even(t) else [] for t in texts]
        heads = self.encode([c[0] if c else t for c, t in zip(chunks, texts)])  # texts that are not even, whole
        found = [list(map(self.after.get, c[1:])) for c in chunks]
        gaps = [[i for i, x in enumerate(f) if x is None] if None in f else () for f in found]
        new = self._resolved({c[i + 1] for c, g in zip(chunks, gaps) for i in g})
        for f, c, g in zip(found, chunks, gaps):
            for i in g:
                f[i] = new[c[i + 1]]
        return [h + b"".join(f) for h, f in zip(heads, found)]

    def _resolved(self, chunks: set[str]) -> dict[str, bytes]:
        """The ids of chunks that follow a space; as many as there is room for are kept."""
        known = self.after
        stems = {c: c[:-1] if c[-1] in CLOSING and c[-2:-1].isalpha() else c for c in chunks if c}
        unknown = [s for s in {*stems.values()} if s not in known]
        ids = dict(zip(unknown, self.encode([" " + s for s in unknown])))
        out = {}
        for c, s in stems.items():
            body = ids.get(s) or known[s]
            out[c] = body if c == s else body + self.marks[c[-1]]
        for part in (ids, out):
            for c, value in part.items():
                if len(known) >= CACHE:
                    return out
                if len(c) <= LONGEST:
                    known[c] = value
        return out


_tokens: dict[str, Tokens] = {}


def _loaded(path: str) -> Tokens:
    if path not in _tokens:
        _tokens[path] = Tokens(path)
    return _tokens[path]


class Bins:
    """Open bins in stacks by free space, and a bitset of the free spaces that have one."""

    def __init__(self, size: int, most: int):
        self.size, self.most, self.open, self.free, self.stacks, self.next = size, most, 0, 0, {}, 0

    def place(self, n: int) -> tuple[int, int]:
        """The bin of a piece of n tokens and its offset there."""
        fitting = self.free >> n
        if fitting:
            space = n + (fitting & -fitting).bit_length() - 1
            number = self._take(space)
        else:
            space, number = self.size, self.next
            self.next += 1
            if self.open >= self.most:
                self._take((self.free & -self.free).bit_length() - 1)  # the fullest closes
        if space > n:
            self.stacks.setdefault(space - n, []).append(number)
            self.free |= 1 << (space - n)
            self.open += 1
        return number, self.size - space

    def _take(self, space: int) -> int:
        stack = self.stacks[space]
        number = stack.pop()
        self.open -= 1
        if not stack:
            self.free &= ~(1 << space)
        return number


def pack_documents(docs: DataFrame, tokenizer: str, length: int = LENGTH, separator: int = SEPARATOR, most: int = OPEN) -> DataFrame:
    """doc_id, piece, start, length, ids (little-endian unsigned 32-bit), sequence_id and offset of every piece of every document.

    `tokenizer`: a file that each worker has. Sequences of different tasks have different numbers.
    """
    end = array("I", [separator]).tobytes()
    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, piece int, start bigint, length bigint, ids binary, sequence_id bigint, offset bigint"

    def fill(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, bins, base = _loaded(tokenizer), Bins(length, most), TaskContext.get().partitionId() << 40
        waiting: list[tuple] = []
        held = 0

        def placed(doc_type: pa.DataType) -> Iterator[pa.RecordBatch]:
            waiting.sort(key=lambda w: -w[3])  # stable, so equal lengths keep the order they came in
            for at in range(0, len(waiting), 512):
                part = waiting[at : at + 512]
                doc, piece, start, n, ids = zip(*part)
                number, offset = zip(*map(bins.place, n))
                columns = [pa.array(doc, doc_type), pa.array(piece, pa.int32()), pa.array(start, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array([base + x for x in number], pa.int64()), pa.array(offset, pa.int64())]
                yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "piece", "start", "length", "ids", "sequence_id", "offset"])
            waiting.clear()

        doc_type = None
        for batch in batches:
            doc_type = batch.schema.field("doc_id").type
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                for doc, body in zip(part.column("doc_id").to_pylist(), tokens.of([t or "" for t in part.column("text").to_pylist()])):
                    body += end
                    n = len(body) // 4
                    first = n if n <= length else n % length or length
                    for k, (a, b) in enumerate(zip([0, *range(first, n, length)], [*range(first, n, length), n])):
                        waiting.append((doc, k, a, b - a, body[4 * a : 4 * b]))
                        held += 4 * (b - a)
                if held >= WINDOW:
                    yield from placed(doc_type)
                    held = 0
        if waiting:
            yield from placed(doc_type)

    return docs.select("doc_id", "text").mapInArrow(fill, schema)
