"""Byte-level BPE: encoding by a queue of merge ranks over a linked list of symbols, and decoding."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from harborlens.llm.common import ship_package

#: How byte-level BPE cuts a text before the merges (fixed by the vocabulary).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

#: The same cuts at white space only: no cut of PATTERN reaches across one of these.
CHUNK = r" ?\S+|\s+(?!\S)|\s+"


def byte_letters() -> dict[int, str]:
    """The printable letter by which a byte-level vocabulary writes each byte."""
    own = [*range(ord("!"), ord("~") + 1), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


class Bpe:
    """A tokenizer file of byte-level BPE: merges by rank, and special tokens that are cut out of texts first."""

    def __init__(self, path: str, memo: int = 500_000) -> None:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        self._check(data)
        byte = {c: b for b, c in byte_letters().items()}
        raw = {t: bytes(byte[c] for c in t) for t in data["model"]["vocab"]}
        self.ids = {raw[t]: i for t, i in data["model"]["vocab"].items()}
        self.special = {a["content"]: a["id"] for a in data["added_tokens"]}
        self.words = {i: b for b, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        self.bytes, self.ranks = [self.ids.get(bytes((b,))) for b in range(256)], {}
        for rank, m in enumerate(data["model"]["merges"]):
            a, b = (raw[t] for t in (m if isinstance(m, list) else m.split(" ")))
            self.ranks[self.ids[a], self.ids[b]] = rank, self.ids[a + b]
        self.find, self.chunks = regex.compile(PATTERN).findall, regex.compile(CHUNK).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.memo, self.most = {}, memo

    @staticmethod
    def _check(data: dict) -> None:
        """Refuses a file with settings that this class doesn't follow, rather than encode otherwise than it says."""
        model, cut = data["model"], data.get("pre_tokenizer") or {}
        wrong = [k for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges") if model.get(k)]
        wrong += ["normalizer"] * bool(data.get("normalizer")) + ["model type"] * (model.get("type", "BPE") != "BPE")
        wrong += ["pre_tokenizer"] * (cut.get("type") != "ByteLevel" or bool(cut.get("add_prefix_space")) or cut.get("use_regex", True) is not True)
        wrong += ["added_tokens"] * any(a.get(k) for a in data["added_tokens"] for k in ("lstrip", "rstrip", "single_word"))
        if wrong:
            raise ValueError(f"a tokenizer file with settings that aren't supported: {', '.join(wrong)}")

    def merge(self, word: bytes) -> list[int]:
        """Token ids of one word: pairs leave a heap by rank and place; an entry whose symbols have changed since is skipped."""
        symbols = list(map(self.bytes.__getitem__, word))
        n, ranks = len(symbols), self.ranks.get
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        heap = [(r[0], i, a, b, r[1]) for i, (a, b) in enumerate(zip(symbols, symbols[1:], strict=False)) if (r := ranks((a, b)))]
        heapify(heap)
        while heap:
            _, i, a, b, both = heappop(heap)
            j = after[i]
            if symbols[i] != a or j >= n or symbols[j] != b:
                continue
            symbols[i], symbols[j] = both, None
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if r := ranks((both, symbols[k])):
                    heappush(heap, (r[0], i, both, symbols[k], r[1]))
            if (h := before[i]) >= 0 and (r := ranks((symbols[h], both))):
                heappush(heap, (r[0], h, symbols[h], both, r[1]))
        return [s for s in symbols if s is not None]

    def encode(self, text: str) -> list[int]:
        out: list[int] = []
        memo = self.memo
        for piece in self.cut.split(text) if self.cut else (text,):
            if piece in self.special:
                out.append(self.special[piece])
                continue
            for chunk in self.chunks(piece):
                ids = memo.get(chunk)
                if ids is None:
                    ids = []
                    for word in self.find(chunk):
                        part = memo.get(word)
                        if part is None:
                            part = self._kept(word, self.merge(word.encode()))
                        ids += part
                    if len(ids) > len(part):
                        self._kept(chunk, ids)
                out += ids
        return out

    def _kept(self, word: str, ids: list[int]) -> list[int]:
        if len(word) < 32:  # long words seldom return
            if len(self.memo) >= self.most:
                self.memo.clear()
            self.memo[word] = ids
        return ids

    def decode(self, ids: list[int]) -> str:
        """The tokens' bytes one after another; bytes that are no UTF-8 become U+FFFD, and ids that no token has are passed over."""
        try:
            return b"".join(map(self.words.__getitem__, ids)).decode("utf-8", "replace")
        except (KeyError, IndexError, TypeError):
            return b"".join(self.words[i] for i in ids if i in self.words).decode("utf-8", "replace")


def _loaded(path: str, cache: dict = {}) -> Bpe:  # noqa: B006  one for each Python worker
    if path not in cache:
        cache[path] = Bpe(path)
    return cache[path]


def map_tokens(docs: DataFrame, path: str, make: Callable[[Bpe, str], tuple], schema: str, id_col: str, text_col: str) -> DataFrame:
    """(id, *make(tokenizer, text)) of every row. Texts pass one at a time and rows go out in small batches, so memory is bounded by the longest text."""
    names = [x.strip().split(" ")[0] for x in schema.split(", ")]
    ship_package(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path)
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                made = [make(bpe, t.as_py() or "") for t in b.column(1)]
                columns = [pa.array(list(c)) for c in zip(*made, strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=["id", *names])

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"id {kind}, {schema}").withColumnRenamed("id", id_col)


def bpe_encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids array<int>) of every row: the whole text's token ids; special tokens written in a text are recognised.

    Null texts count as empty ones and have no ids. Repeated rows, null ids and other
    columns do no harm; an empty table gives no rows. ``path`` is a tokenizer file
    (JSON, byte-level BPE) that each executor has.
    """

    def make(bpe: Bpe, text: str) -> tuple:
        ids = bpe.encode(text)
        return len(ids), pa.scalar(ids, pa.list_(pa.int32()))

    return map_tokens(docs, path, make, "n_tokens long, ids array<int>", id_col, text_col)


def bpe_decode(tokens: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(id, text) of every row of (id, ids): the vocabulary strings one after another. Null ids give an empty text; null elements and ids
    outside the vocabulary are passed over, as the tokenizers library does; repeated rows have a row each."""
    ship_package(tokens.sparkSession)
    kind = tokens.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = _loaded(path)
        for b in batches:
            texts = pa.array([bpe.decode(x.as_py() or []) for x in b.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([b.column(0), texts], names=["id", "text"])

    return tokens.select(F.col(id_col).alias("id"), F.col(ids_col).alias("ids")).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_col)


def bpe_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every row: the whole text encoded and decoded again, as digests.

    Null texts count as empty ones. Null ids and repeated rows have a row each; other columns are ignored; an empty table gives no rows.
    """
    import hashlib

    def make(bpe: Bpe, text: str) -> tuple:
        ids = bpe.encode(text)
        return len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(bpe.decode(ids).encode()).hexdigest()

    return map_tokens(docs, path, make, "n_tokens long, ids_sha256 string, decoded_sha256 string", id_col, text_col)
