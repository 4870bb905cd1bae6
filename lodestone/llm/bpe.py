"""BPE encoding and decoding by a tokenization automaton.

The merges of a vocabulary file compile into a deterministic automaton over tokens. It starts with one state in which
every base symbol loops. Merge number k of (u, v) applies one gadget: the state that u leads to is copied without its
arc v (u then v no longer spells a path), u's arcs go to the copy, and wherever u could be taken, an arc uv now leads
to the state that v led to before. A text then has exactly one path, and it is the result of the merges.

A copy is its original plus one removed arc, so a state is kept as its chain of removed arcs, each with the number of
its gadget, and ``TokenAutomaton.removed`` is that table. Two things tell when a removed arc v counts for an arc w out
of the state after x, and are tables too (``ends`` and ``begins``): x leads where its last part r led when x was made,
so removals from r's state count up to then; and w was added where its first part was still an arc when w was made, so
removals of l count up to then. ``follows`` is one look into these tables for each pair of parts, a handful.

Words are read left to right: a trie over base symbols proposes the tokens that start at each position, the tables
accept or refuse them, and a prefix has one accepted path at most, so an end that fails is never tried again. Arc labels
give the text back.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: White space as Unicode defines it; U+001C to U+001F are not part of it.
SPACE = "\\t-\\r \\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000"
#: Fixed value: the pattern that splits words into pieces.
PIECES = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
#: Words longer than this are encoded without the cache, which holds so many words in each of its two generations.
CACHED_CHARS, CACHED_WORDS = 48, 200_000
#: Text characters that go into one batch of results, about.
SLICE_CHARS = 2_000_000


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself if printable in Latin-1, else the next from U+0100."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in shown else chr(next(rest)) for b in range(256)]


class Seen(dict):
    """What ``make`` gives for the keys seen of late: two generations of at most about CACHED_WORDS keys each."""

    def __init__(self, make, old: dict | None = None):
        self.make, self.old = make, old or {}

    def __missing__(self, key: str) -> bytes:
        found = self.old.get(key)
        if found is None:
            found = self.make(key)
        if len(key) <= CACHED_CHARS:
            self[key] = found
        return found

    def turned(self) -> Seen:
        if len(self) < CACHED_WORDS:
            return self
        self.old = {}
        return Seen(self.make, self)


class TokenAutomaton:
    """The compiled vocabulary. ``spec`` is the parsed vocabulary file (JSON of the tokenizers library)."""

    def __init__(self, spec: dict):
        model, suffix = spec["model"], spec["model"].get("end_of_word_suffix") or ""
        normal = [x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        if model["type"] != "BPE" or normal != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in splits] != ["Split", "ByteLevel"] or spec["decoder"]:
            raise ValueError("this automaton reads word-splitting, lower-casing BPE files with byte symbols and no decoder")
        if splits[0]["pattern"]["Regex"] != PIECES:
            raise ValueError("this automaton knows one way to split words")
        self.ascii_pieces = re.compile(PIECES.replace("\\p{L}", "a-z").replace("\\p{N}", "0-9"), re.A).findall
        self.spaces = re.compile(f"[{SPACE}]+")
        vocab = model["vocab"]
        self.labels = [""] * (1 + max([*vocab.values(), *(x["id"] for x in spec["added_tokens"])]))
        for label, i in vocab.items():
            self.labels[i] = label
        self.added = {x["content"]: x["id"] for x in spec["added_tokens"]}
        for label, i in self.added.items():
            self.labels[i] = label
        self.added_split = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        symbols = byte_symbols()
        self.inner = [vocab[s] for s in symbols]
        self.final = [vocab[s + suffix] for s in symbols]
        self.trie: dict | None = None
        self.unicode: tuple | None = None
        self.source = (vocab, model["merges"])  # compiled when the first word comes; a worker that decodes never does
        self.words, self.pieces_seen = Seen(self._chunk), Seen(self._word_ids)

    def _compile(self) -> None:
        vocab, merges = self.source
        self.source, n = None, len(self.labels)
        left, right, made = [-1] * n, [-1] * n, [-1] * n
        #: For each token, the arcs removed from the state that it leads to, and the gadgets that did it.
        self.removed: list[dict[int, int] | None] = [None] * n
        for k, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            if made[w] >= 0 or k <= max(made[u], made[v]):
                raise ValueError("a merge makes a token twice, or uses one before it is made")
            if self.removed[u] is None:
                self.removed[u] = {}
            self.removed[u][v] = k
            left[w], right[w], made[w] = u, v, k
        #: For each token, its last parts with removals and its first parts, each with the gadget up to which it counts.
        self.ends: list[tuple] = [()] * n
        self.begins: list[tuple] = [()] * n
        spelled: dict[int, str] = {}
        for b in range(256):
            spelled[self.inner[b]], spelled[self.final[b]] = chr(b), chr(256 + b)
        never = len(merges)
        for w in sorted(range(n), key=made.__getitem__):
            if made[w] >= 0:
                spelled[w] = spelled[left[w]] + spelled[right[w]]
            own = [] if self.removed[w] is None else [(self.removed[w], never)]
            made_of = made[w] >= 0
            self.ends[w] = (*own, *((x, min(until, made[w])) for x, until in (self.ends[right[w]] if made_of else ())))
            # The gadget that made w removed its arc first: in "ooo" the first two letters are the pair.
            self.begins[w] = ((w, never), *((x, min(until, made[w] + 1)) for x, until in (self.begins[left[w]] if made_of else ())))
        self.trie = {}
        for t, path in spelled.items():
            node = self.trie
            for symbol in path:
                node = node.setdefault(symbol, {})
            node[""] = t

    def follows(self, t: int, w: int) -> bool:
        """Whether the state after token ``t`` has an arc ``w``."""
        if self.trie is None:
            self._compile()
        for gone, until in self.ends[t]:
            for part, counts in self.begins[w]:
                k = gone.get(part)
                if k is not None and k < until and k < counts:
                    return False
        return True

    def _starts(self, path: str, at: int) -> list[tuple[int, int]]:
        """The tokens that start at ``at`` and where they end, the longest last."""
        node, found = self.trie, []
        for e in range(at, len(path)):
            node = node.get(path[e])
            if node is None:
                break
            t = node.get("")
            if t is not None:
                found.append((t, e + 1))
        return found

    def word(self, piece: str) -> list[int]:
        """The tokens of one pre-split word: the accepted path, looked for with long tokens first.

        A prefix has one accepted path at most, so an end from which no path goes on is never tried again, and the work
        is bounded by the word's length times the longest token's.
        """
        if self.trie is None:
            self._compile()
        data = piece.encode()
        path = data[:-1].decode("latin-1") + chr(256 + data[-1])
        n, tokens, ends, waiting, dead = len(path), [], [0], [], set()
        open_, follows = self._starts(path, 0), self.follows
        while True:
            while open_:
                t, e = open_.pop()
                if e in dead:
                    continue
                if tokens and not follows(tokens[-1], t):
                    continue
                tokens.append(t)
                if e == n:
                    return tokens
                ends.append(e)
                waiting.append(open_)
                open_ = self._starts(path, e)
            dead.add(ends.pop())
            tokens.pop()
            open_ = waiting.pop()

    def _word_ids(self, piece: str) -> bytes:
        return np.array(self.word(piece), "<u4").tobytes()

    def _library(self):
        """The library's Unicode steps, for what is not ASCII: which characters are letters, and how they lower."""
        if self.unicode is None:
            from tokenizers import Regex, normalizers, pre_tokenizers

            form = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()])
            self.unicode = form.normalize_str, pre_tokenizers.Split(Regex(PIECES), "removed", invert=True).pre_tokenize_str
        return self.unicode

    def _chunk(self, raw: str) -> bytes:
        """The ids of one run without white space, little-endian."""
        if raw.isascii():
            pieces = self.ascii_pieces(raw.lower())
        else:
            normal, split = self._library()
            pieces = [piece for piece, _ in split(normal(raw))]
        return b"".join(map(self.pieces_seen.__getitem__, pieces))

    def encode(self, text: str | None) -> bytes:
        """All ids of a text as little-endian unsigned 32-bit integers; null is empty."""
        if not text:
            return b""
        if self.added_split and "<|" in text or self.added_split and any(x in text for x in self.added if "<|" not in x):
            parts = self.added_split.split(text)
            return b"".join(np.array([self.added[p]], "<u4").tobytes() if i % 2 else self._plain(p) for i, p in enumerate(parts))
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        words = text.split()
        if any(c in text for c in "\x1c\x1d\x1e\x1f"):
            words = [w for w in self.spaces.split(text) if w]
        self.words, self.pieces_seen = self.words.turned(), self.pieces_seen.turned()
        return b"".join(map(self.words.__getitem__, words))

    def decode(self, ids: bytes | None) -> str:
        """The labels of the arcs, with a space between."""
        labels = self.labels
        return " ".join([labels[i] for i in np.frombuffer(ids or b"", "<u4").tolist()])


def read_spec(path: str) -> dict:
    with open(path, encoding="utf-8") as f:
        return json.load(f)


_COMPILED: dict[int, TokenAutomaton] = {}


def automaton(shared) -> TokenAutomaton:
    """The compiled automaton of a broadcast file, once for each Python worker."""
    key = shared._jbroadcast.id() if getattr(shared, "_jbroadcast", None) else id(shared.value)
    if key not in _COMPILED:
        _COMPILED.clear()
        _COMPILED[key] = TokenAutomaton(shared.value)
    return _COMPILED[key]


def _slices(column: pa.Array) -> Iterator[list]:
    """Rows of a column, as many at a time as hold about SLICE_CHARS."""
    at, n = 0, len(column)
    each = max(1, min(4096, n * SLICE_CHARS // max(1, column.nbytes)))
    while at < n:
        yield column.slice(at, each).to_pylist()
        at += each


def _mapped(df: DataFrame, column: str, out: str, kind: str, shared, method: str) -> DataFrame:
    """``df`` with one more column, made by the automaton's ``method`` from ``column``."""
    names = df.columns
    place, typed = names.index(column), pa.binary() if kind == "binary" else pa.string()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = getattr(automaton(shared), method)
        for batch in batches:
            at = 0
            for values in _slices(batch.column(place)):
                made = pa.array([call(v) for v in values], typed)
                yield pa.RecordBatch.from_arrays([*(c.slice(at, len(values)) for c in batch.columns), made], [*names, out])
                at += len(values)

    return df.mapInArrow(run, df.select("*", F.lit(None).cast(kind).alias(out)).schema)


def share(spark, path: str):
    """Broadcast the vocabulary file; its size is bounded by the vocabulary, not by the data."""
    return spark.sparkContext.broadcast(read_spec(path))


def encode(docs: DataFrame, vocabulary, text_col: str = "text", ids_col: str = "ids") -> DataFrame:
    """``docs`` with ``ids_col``: each whole text's ids as little-endian unsigned 32-bit integers.

    ``vocabulary`` is a path or the result of ``share``. Null and empty texts give no ids. Every row is kept, repeated
    rows too, and so are all other columns; an existing column called ``ids_col`` is replaced. Memory: a slice of about
    SLICE_CHARS characters, or one text if that is longer.
    """
    shared = share(docs.sparkSession, vocabulary) if isinstance(vocabulary, str) else vocabulary
    return _mapped(docs.drop(ids_col), text_col, ids_col, "binary", shared, "encode")


def decode(encoded: DataFrame, vocabulary, ids_col: str = "ids", text_col: str = "decoded") -> DataFrame:
    """``encoded`` with ``text_col``: the labels of the ids, joined by spaces; null ids give an empty text."""
    shared = share(encoded.sparkSession, vocabulary) if isinstance(vocabulary, str) else vocabulary
    return _mapped(encoded.drop(text_col), ids_col, text_col, "string", shared, "decode")


def default_vocabulary() -> str:
    """The place of the public word vocabulary that is installed beside the libraries."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_query(spark, sf_dir: str, vocabulary: str | None = None) -> DataFrame:
    shared = share(spark, vocabulary or default_vocabulary())
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    ids = encode(docs, shared).select("doc_id", "ids")
    both = decode(ids, shared)
    return both.select(
        "doc_id",
        F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )
