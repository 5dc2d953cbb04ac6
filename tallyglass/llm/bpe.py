"""Byte-pair encoding and decoding of whole texts, exactly as the `tokenizers` library does it.

A tokenizer file splits a text into pieces that it encodes one by one, so a task keeps the ids of
pieces it has seen. Texts with an unsplit run of `LONG` characters or more take another way, the tree
concatenation: a run is cut into leaves that are encoded in parallel as rows of their own, and
neighbours are joined level by level. At a join the last tokens of the left and the first tokens of
the right side are encoded anew together; the window grows until its first and its last token are
those that the sides have there. Then every pair of neighbours in the joined row of tokens is one
that the merges leave alone, which makes the row the encoding of the whole.

Edge cases: null text counts as empty (no ids). The strings of the file's special tokens become their
ids, as in the library. Truncation and padding of the file are not used. Rows are treated one by one,
so repeated rows get equal results; of other columns nothing is read. An empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import unicodedata
from collections.abc import Callable, Iterator
from functools import cached_property, lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tallyglass.plans.registry import query, table
from tallyglass.session import materialise

LONG = 4096
CACHE_BYTES = 240 << 20  # of pieces that a task remembers; then it starts anew
WINDOW = 8
_PLAIN = 0x180        # below, NFC changes nothing and lower case works letter by letter


def _ranges(test) -> str:
    """The characters below _PLAIN that pass a test, as the inside of a character class."""
    return "".join(f"\\u{c:04x}" for c in range(_PLAIN) if test(chr(c)))


_LETTER = _ranges(lambda c: unicodedata.category(c)[0] == "L")
_DIGIT = _ranges(lambda c: unicodedata.category(c)[0] == "N")
_SPACE = r"\t\n\x0b\x0c\r \x85\xa0"
_ENDINGS = "'(?:s|t|re|ve|m|ll|d)"
# The two splitting rules of the files, for plain characters, by what the file says.
_WORDS = re.compile(f"[{_LETTER}]+|[{_DIGIT}]|{_ENDINGS}|[^{_SPACE}{_LETTER}{_DIGIT}]+")
_SPACED = re.compile(f" ?[{_LETTER}]+| ?[{_DIGIT}]+|{_ENDINGS}| ?[^{_SPACE}{_LETTER}{_DIGIT}]+|"
                     f"[{_SPACE}]+(?![^{_SPACE}])|[{_SPACE}]+")
_NOT_PLAIN = re.compile(f"[^\\x00-\\u{_PLAIN - 1:04x}]")

# The alphabet of the merges: a printable character for each byte, its own where that is printable.
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
_ALPHABET = {b: 256 + i for i, b in enumerate(sorted(set(range(256)) - set(_SHOWN)))}


class Codec:
    """One tokenizer file inside a task."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path, self.spec = path, spec
        self.suffix = spec["model"].get("end_of_word_suffix") or ""
        self.closed = self._bare()     # takes strings in the alphabet of the merges, one piece at a time
        self.lower = spec["normalizer"] is not None
        self.rule = _WORDS if self.lower else _SPACED
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.marks = re.compile("|".join(map(re.escape, self.special))) if self.special else None
        self.joins_blank = spec["decoder"] is None
        self.cache: dict[str, bytes] = {}
        self.held = 0

    def _bare(self, **model):
        """The merges alone."""
        from tokenizers import Tokenizer

        bare = self.spec | {"normalizer": None, "added_tokens": [], "post_processor": None, "decoder": None, "truncation": None, "padding": None,
                            "pre_tokenizer": None, "model": self.spec["model"] | model}
        return Tokenizer.from_str(json.dumps(bare))

    # Most texts need neither of these.

    @cached_property
    def whole(self):
        from tokenizers import Tokenizer

        whole = Tokenizer.from_file(self.path)
        whole.no_truncation()
        whole.no_padding()
        return whole

    @cached_property
    def open(self):
        return self._bare(end_of_word_suffix=None) if self.suffix else self.closed

    @cached_property
    def tokens(self) -> list[str]:
        return [self.whole.id_to_token(i) for i in range(self.whole.get_vocab_size())]

    def _learn(self, pieces) -> None:
        if self.held > CACHE_BYTES:
            self.cache.clear()
            self.held = 0
        merge = self.closed.model.tokenize     # without the outer steps of the library, which cost more than the merges
        for p in list(pieces):
            self.cache[p] = ids = np.array([t.id for t in merge(p.encode().decode("latin-1").translate(_ALPHABET))], "<u4").tobytes()
            self.held += 2 * len(p) + len(ids) + 200

    def _plain(self, text: str) -> list[str] | None:
        """Pieces of a text that has plain characters and no special token, else nothing."""
        if not text.isascii() and _NOT_PLAIN.search(text) or self.marks and self.marks.search(text):
            return None
        return self.rule.findall(text.lower() if self.lower else text)

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        split = [self._plain(t or "") for t in texts]
        out = []
        for t, pieces in zip(texts, split):
            if pieces is None:
                out.append(np.array(self.whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes())
                continue
            try:
                out.append(b"".join(map(self.cache.__getitem__, pieces)))
            except KeyError:
                known = self.cache
                self._learn({p for p in pieces if p not in known} if self.held <= CACHE_BYTES else set(pieces))
                out.append(b"".join(map(self.cache.__getitem__, pieces)))
        return out

    def decode(self, ids: bytes) -> str:
        numbers = np.frombuffer(ids, "<u4").tolist()
        if self.joins_blank:
            return " ".join(map(self.tokens.__getitem__, numbers))
        return self.whole.decode(numbers, skip_special_tokens=False)

    # Tree concatenation. Leaves are strings in the alphabet of the merges (a character for each byte).

    def leaves(self, text: str) -> list[tuple[int, int, str, bool]]:
        """(run, leaf, string, ends its run) of a text; special tokens are runs of their own, marked by leaf -1."""
        out, run = [], 0
        at = 0
        parts = []
        for m in self.marks.finditer(text) if self.marks else ():
            parts += [(text[at:m.start()], None), ("", m.group())]
            at = m.end()
        for part, mark in [*parts, (text[at:], None)]:
            if mark:
                out.append((run, -1, mark, True))
                run += 1
                continue
            part = self.whole.normalizer.normalize_str(part) if self.lower else part
            for piece, _ in self.whole.pre_tokenizer.pre_tokenize_str(part) if part else ():
                cuts = range(0, len(piece), LONG)
                out += [(run, k, piece[c:c + LONG], c + LONG >= len(piece)) for k, c in enumerate(cuts)]
                run += 1
        return out

    def encode_leaf(self, string: str, leaf: int, ends: bool) -> bytes:
        if leaf < 0:
            return np.array([self.special[string]], "<u4").tobytes()
        model = self.closed if ends else self.open
        return np.array(model.encode(string, add_special_tokens=False).ids, "<u4").tobytes()

    def join(self, left: bytes, right: bytes, ends: bool) -> bytes:
        """The encoding of two neighbours of one run; `ends`: the right one ends the run."""
        a, b = np.frombuffer(left, "<u4"), np.frombuffer(right, "<u4")
        k = WINDOW
        while True:
            i, j = max(0, len(a) - k), min(len(b), k)
            closes = ends and j == len(b)
            text = "".join(self.tokens[t] for t in [*a[i:].tolist(), *b[:j].tolist()])
            if closes and self.suffix:
                text = text.removesuffix(self.suffix)
            new = (self.closed if closes else self.open).encode(text, add_special_tokens=False).ids
            if (i == 0 or new[0] == a[i]) and (j == len(b) or new[-1] == b[j - 1]):
                return a[:i].tobytes() + np.array(new, "<u4").tobytes() + b[j:].tobytes()
            k *= 2


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    return Codec(path)


def _slices(texts: list, most: int = 1 << 20) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= most:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(texts):
        yield start, len(texts)


def is_long(text):
    """Whether a text has a run of LONG characters that no tokenizer rule is sure to split."""
    return F.coalesce(F.length(text) >= LONG, F.lit(False)) & F.coalesce(text.rlike(r"[^ \t\n\r]{%d}" % LONG), F.lit(False))


def _encoded(batches: Iterator[pa.RecordBatch], path: str, finish, names: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of (text, other columns...) to (what finish makes of the ids, other columns...)."""
    c = codec(path)
    for batch in batches:
        texts = batch.column(0).to_pylist()
        for a, b in _slices(texts):
            made = finish(c, c.encode_batch(texts[a:b]))
            yield pa.RecordBatch.from_arrays([*made, *(x.slice(a, b - a) for x in batch.columns[1:])], names=names)


def encode_long(docs: DataFrame, text: str, path: str, keys: list[str]) -> DataFrame:
    """`ids` and the key columns for rows with long runs, by tree concatenation. Keys tell the rows apart."""
    kinds = ", ".join(f"`{k}` {dict(docs.dtypes)[k]}" for k in keys)

    def cut(batches):
        c = codec(path)
        for batch in batches:
            for i, t in enumerate(batch.column(0).to_pylist()):
                runs = c.leaves(t or "")
                own = [pa.array([x[i].as_py()] * len(runs), x.type) for x in batch.columns[1:]]
                cols = [pa.array(v, kind) for v, kind in zip(zip(*runs), (pa.int64(), pa.int64(), pa.string(), pa.bool_()))] if runs else \
                    [pa.array([], kind) for kind in (pa.int64(), pa.int64(), pa.string(), pa.bool_())]
                yield pa.RecordBatch.from_arrays([*own, *cols], names=[*keys, "run", "leaf", "part", "ends"])

    def leaf_ids(batches):
        c = codec(path)
        for batch in batches:
            n = len(keys)
            leaf, part, ends = (batch.column(n + k).to_pylist() for k in (1, 2, 3))
            ids = [c.encode_leaf(p, k, e) for k, p, e in zip(leaf, part, ends)]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n + 2], batch.column(n + 3), pa.array(ids, pa.binary())],
                                             names=[*keys, "run", "leaf", "ends", "ids"])

    def joined(batches):
        c = codec(path)
        for batch in batches:
            n = len(keys)
            both = batch.column(n + 2).to_pylist()
            ids = [x[0]["ids"] if len(x) == 1 else c.join(x[0]["ids"], x[1]["ids"], x[1]["ends"]) for x in both]
            ends = [x[-1]["ends"] for x in both]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n + 2], pa.array(ends, pa.bool_()), pa.array(ids, pa.binary())],
                                             names=[*keys, "run", "leaf", "ends", "ids"])

    shape = f"{kinds}, run long, leaf long, ends boolean, ids binary"
    by = [F.col(f"`{k}`") for k in keys]
    level = docs.select(text, *by).mapInArrow(cut, f"{kinds}, run long, leaf long, part string, ends boolean") \
        .repartition(*by, "run", "leaf").mapInArrow(leaf_ids, shape)
    level = materialise(level)
    most = level.agg(F.max("leaf")).first()[0] or 0
    while most > 0:
        level = level.groupBy(*by, "run", F.floor(F.col("leaf") / 2).alias("leaf")).agg(
            F.array_sort(F.collect_list(F.struct("leaf", "ends", "ids"))).alias("both")).mapInArrow(joined, shape)   # two rows at most
        most //= 2
    whole = level.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("run", "ids"))).alias("runs"))
    return whole.select(*by, F.aggregate("runs", F.expr("cast('' as binary)"), lambda a, r: F.concat(a, r["ids"])).alias("ids"))


def token_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def encode(docs: DataFrame, text: str, path: str, keep: list[str]) -> DataFrame:
    """`ids` (little-endian unsigned 32-bit) and the `keep` columns of every row."""
    finish = lambda c, ids: [pa.array(ids, pa.binary())]
    return _both_ways(docs, text, path, keep, "ids binary", finish, ["ids"])


def encode_once(docs: DataFrame, text: str, path: str, keep: list[str], then: Callable, shape: str) -> tuple[DataFrame, Observation, Callable[[], DataFrame]]:
    """`encode` for a caller that writes the result: (rows of short texts, observation, rows of long texts).

    `then` turns the batches (ids and the `keep` columns) into those of `shape` in the worker that encoded them. The texts
    are read once: when the first part is written, `long` of the observation says how many long texts there are,
    and only if there are any the second part is needed.
    """
    columns, seen = [F.col(f"`{k}`") for k in keep], Observation()
    finish = lambda c, ids: [pa.array(ids, pa.binary())]
    marked = docs.select(F.col(text).alias("_text"), *columns, is_long(F.col(text)).alias("_long")).observe(seen, F.count_if("_long").alias("long"))
    short = marked.where("NOT _long").drop("_long").mapInArrow(lambda it: then(_encoded(it, path, finish, ["ids", *keep])), shape)
    kinds = ", ".join(["ids binary", *(f"`{k}` {dict(docs.dtypes)[k]}" for k in keep)])
    return short, seen, lambda: _long_ways(docs, text, path, keep, kinds, finish, ["ids"]).mapInArrow(then, shape)


def _both_ways(docs, text, path, keep, kinds, finish, names):
    columns = [F.col(f"`{k}`") for k in keep]
    shape = ", ".join([kinds, *(f"`{k}` {dict(docs.dtypes)[k]}" for k in keep)])
    short = docs.where(~is_long(F.col(text))).select(F.col(text).alias("_text"), *columns).mapInArrow(
        lambda it: _encoded(it, path, finish, [*names, *keep]), shape)
    if docs.where(is_long(F.col(text))).isEmpty():   # stops at the first such row
        return short
    return short.unionByName(_long_ways(docs, text, path, keep, shape, finish, names))


def _long_ways(docs, text, path, keep, shape, finish, names):
    columns = [F.col(f"`{k}`") for k in keep]
    long = materialise(docs.where(is_long(F.col(text))).select(F.monotonically_increasing_id().alias("_row"), F.col(text).alias("_text"), *columns))
    ids = long.select("_row", *columns).join(encode_long(long, "_text", path, ["_row"]), "_row", "left").select(
        F.coalesce("ids", F.expr("cast('' as binary)")).alias("ids"), *columns)

    def finished(batches):
        c = codec(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*finish(c, batch.column(0).to_pylist()), *batch.columns[1:]], names=[*names, *keep])

    return ids.mapInArrow(finished, shape)


def digests(c: Codec, ids: list[bytes]) -> list[pa.Array]:
    return [pa.array([len(x) // 4 for x in ids], pa.int64()),
            pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
            pa.array([hashlib.sha256(c.decode(x).encode()).hexdigest() for x in ids])]


@query("op1_bpe")
def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents", "doc_id", "text")
    names = ["n_tokens", "ids_sha256", "decoded_sha256"]
    out = _both_ways(docs, "text", token_path("word_bpe_49k.json"), ["doc_id"],
                     "n_tokens long, ids_sha256 string, decoded_sha256 string", digests, names)
    return out.select("doc_id", *names)
