"""BPE encoding and decoding by batched numpy merge rounds.

The vocabulary is a tokenizers JSON file of the kind "word BPE": texts are put in NFC and lower case, split into words by a
pattern (white space goes), each word's UTF-8 bytes are symbols, the last one marked as word end, and the pair of neighbours
with the lowest merge rank is merged until none is left.

All words of a batch that the task has not met before are merged together. Their symbols stand in one flat array; in each
round every pair of neighbours is looked up by binary search in the sorted array of pair keys, each word finds its lowest
rank, and its pairs of that rank are merged, without overlap, from the left. A rank is merged at all its places at once only
if no pair of the merged symbol ranks before it (else the leftmost alone), so the order is that of one merge after the other.
Words over ``LONG`` bytes take a heap instead of rounds, so a text without white space costs n log n.

Ids are kept as packed little-endian unsigned 32-bit integers, ready for training files. Known words are remembered up to
``MEMORY`` words a task. Rows never leave their partition: no shuffle, and batches are cut so that a task holds some MB.

Cases: null counts as empty and gives no ids and an empty decoded text; ids of special tokens written in the text are those
of the tokens, as in the library; repeated rows are encoded each; other columns are not looked at; an empty table gives an
empty table.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.shared import table

LONG = 2_000
MEMORY = 200_000
PART_CHARS = 2_000_000
NONE = np.int64(1 << 40)
PAIR_BITS = 20


def byte_letters() -> list[str]:
    """The letter for each byte in byte-level vocabularies: printable Latin-1 stands for itself, the rest from U+0100 on."""
    keep = {*range(33, 127), *range(161, 173), *range(174, 256)}
    rest = iter(range(256, 512))
    return [chr(b) if b in keep else chr(next(rest)) for b in range(256)]


class Vocabulary:
    """Tables of one tokenizers JSON file and the rounds over them."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, end = model["vocab"], model.get("end_of_word_suffix") or ""
        ids = vocab | {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_re = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.word_re = regex.compile(split["pattern"]["Regex"])
        self.tokens: list[bytes] = [b""] * (max(ids.values()) + 1)
        for t, i in ids.items():
            self.tokens[i] = t.encode()
        letters = byte_letters()
        self.inner = np.array([vocab[c] for c in letters], np.int64)
        self.last = np.array([vocab[c + end] for c in letters], np.int64)
        pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)  # by rank
        key = left << PAIR_BITS | right
        order = np.argsort(key, kind="stable")
        self.keys, self.ranks = key[order], order.astype(np.int64)
        self.rank_of = dict(zip(self.keys.tolist(), self.ranks.tolist(), strict=True))
        first = np.full(len(self.tokens), NONE)  # lowest rank of a pair that has the symbol
        for side in (left, right):
            np.minimum.at(first, side, np.arange(len(pairs)))
        self.at_once = first[self.made] > np.arange(len(pairs))
        self.known: dict[str, bytes] = {}

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        key = left << PAIR_BITS | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.ranks[at], NONE)

    def merge(self, words: list[bytes]) -> list[np.ndarray]:
        """The ids of each non-empty word, by rounds over all of them."""
        out: list[np.ndarray] = [None] * len(words)  # type: ignore[list-item]
        short = [i for i, w in enumerate(words) if len(w) <= LONG]
        for i, w in enumerate(words):
            if len(w) > LONG:
                out[i] = self._merge_long(w)
        if not short:
            return out
        lens = np.array([len(words[i]) for i in short], np.int64)
        raw = np.frombuffer(b"".join([words[i] for i in short]), np.uint8)
        ends = np.cumsum(lens)
        sym = self.inner[raw]
        sym[ends - 1] = self.last[raw[ends - 1]]
        word = np.repeat(np.arange(len(short)), lens)
        while len(sym):
            inside = word[:-1] == word[1:]
            rank = np.full(len(sym), NONE)
            rank[:-1][inside] = self._rank(sym[:-1][inside], sym[1:][inside])
            starts = np.flatnonzero(np.concatenate([[True], ~inside]))
            best = np.minimum.reduceat(rank, starts)
            open_ = best < NONE
            sizes = np.diff(np.append(starts, len(sym)))
            if not open_.all():  # words that are done leave
                for k in np.flatnonzero(~open_).tolist():
                    s = starts[k]
                    out[short[word[s]]] = sym[s : s + sizes[k]]
                stay = np.repeat(open_, sizes)
                sym, word, rank, best, sizes = sym[stay], word[stay], rank[stay], best[open_], sizes[open_]
                if not len(sym):
                    break
            low = np.repeat(best, sizes)
            hit = np.flatnonzero(rank == low)
            fresh = np.concatenate([[True], np.diff(hit) != 1])
            run = np.flatnonzero(fresh)
            take = (np.arange(len(hit)) - run[np.cumsum(fresh) - 1]) % 2 == 0
            first_of_word = np.concatenate([[True], word[hit][1:] != word[hit][:-1]])
            hit = hit[np.where(self.at_once[low[hit]], take, first_of_word)]
            sym[hit] = self.made[rank[hit]]
            rest = np.ones(len(sym), bool)
            rest[hit + 1] = False
            sym, word = sym[rest], word[rest]
        return out

    def _merge_long(self, w: bytes) -> np.ndarray:
        raw = np.frombuffer(w, np.uint8)
        sym = self.inner[raw]
        sym[-1] = self.last[raw[-1]]
        ranks = self._rank(sym[:-1], sym[1:])
        heap = [(int(ranks[i]), int(i)) for i in np.flatnonzero(ranks < NONE)]
        heapq.heapify(heap)
        s, n, none = sym.tolist(), len(sym), int(NONE)
        after, before, rank_at = [*range(1, n), -1], [-1, *range(n - 1)], [*ranks.tolist(), none]

        def look(i: int) -> None:
            j = after[i]
            rank_at[i] = none if j < 0 else self.rank_of.get(s[i] << PAIR_BITS | s[j], none)
            if rank_at[i] < none:
                heapq.heappush(heap, (rank_at[i], i))

        while heap:
            rank, i = heapq.heappop(heap)
            if s[i] < 0 or rank_at[i] != rank:
                continue
            j = after[i]
            s[i], s[j] = int(self.made[rank]), -1
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            look(i)
            if before[i] >= 0:
                look(before[i])
        return np.array([x for x in s if x >= 0], np.int64)

    def split(self, text: str) -> list[str]:
        """Words of a text without special tokens."""
        if text.isascii():
            return self.word_re.findall(text.lower())
        if not "".join(text.split()).isprintable() and any(unicodedata.category(c) == "Cn" for c in set(text)):
            return self._split_new(text)
        if not unicodedata.is_normalized("NFC", text):
            text = unicodedata.normalize("NFC", text)
        return self.word_re.findall(text.replace("Σ", "σ").lower())  # capital sigma never as a final one

    def _split_new(self, text: str) -> list[str]:
        """For texts with characters that Python's Unicode tables don't know: classes and cases are the library's own."""
        from tokenizers import Regex, normalizers, pre_tokenizers

        text = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str(text)
        return [w for w, _ in pre_tokenizers.Split(Regex(self.word_re.pattern), "removed", invert=True).pre_tokenize_str(text)]

    def pieces(self, text: str) -> list[str | int]:
        """Words, and the ids of special tokens that stand in the text."""
        if self.special_re is None or not self.special_re.search(text):
            return self.split(text)
        out: list[str | int] = []
        at = 0
        for m in self.special_re.finditer(text):
            out += [*self.split(text[at : m.start()]), self.special[m[0]]]
            at = m.end()
        return out + self.split(text[at:])

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit integers."""
        parts = [self.pieces(t or "") for t in texts]
        if len(self.known) > MEMORY:
            self.known.clear()
        new = {w for p in parts for w in p if type(w) is str} - self.known.keys()
        if new:
            order = list(new)
            for w, ids in zip(order, self.merge([w.encode() for w in order]), strict=True):
                self.known[w] = ids.astype("<u4").tobytes()
        special = {i: np.array([i], "<u4").tobytes() for i in self.special.values()}
        known = self.known
        return [b"".join([known[w] if type(w) is str else special[w] for w in p]) for p in parts]

    def decode(self, ids: bytes | None) -> str:
        """Tokens joined by spaces, special ones included: this vocabulary names no decoder. Unknown ids give nothing."""
        tokens, n = self.tokens, len(self.tokens)
        return b" ".join([tokens[i] for i in np.frombuffer(ids or b"", "<u4").tolist() if i < n]).decode()


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


def encode(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids (binary) for each row, and with ``decoded`` the text that the ids decode to."""

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        v = vocabulary(path)
        for batch in batches:
            texts, at = batch.column(1).to_pylist(), 0
            while at < len(texts):
                to, chars = at, 0
                while to < len(texts) and (to == at or chars < PART_CHARS):
                    chars += len(texts[to] or "")
                    to += 1
                ids = v.encode(texts[at:to])
                columns = [batch.column(0).slice(at, to - at), pa.array([len(x) // 4 for x in ids], pa.int64()), pa.array(ids, pa.binary())]
                if decoded:
                    columns.append(pa.array([v.decode(x) for x in ids], pa.string()))
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_tokens", "ids", "decoded"][: len(columns)])
                at = to

    schema = "doc_id bigint, n_tokens bigint, ids binary" + ", decoded string" * decoded
    return docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, schema)


def decode(encoded: DataFrame, path: str, ids_col: str = "ids") -> DataFrame:
    """encoded with the column ``decoded``."""

    @F.pandas_udf("string")
    def text_of(ids):  # noqa: ANN001, ANN202
        v = vocabulary(path)
        return ids.map(v.decode)

    return encoded.withColumn("decoded", text_of(F.coalesce(F.col(ids_col), F.lit(b""))))


def public_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = encode(table(spark, sf_dir, "documents"), public_path(), decoded=True)
    return made.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


QUERIES = {"op1_bpe": op1_bpe}
#: Not for SQL: tests/llm compares with the tokenizers library.
ORACLES: dict[str, str] = {}
