"""BPE encoding and decoding (6) as the tokenizers library does it, by tree concatenation on long words.

A text's encoding is that of its runs between white space, one after another, and recurring runs come from a
bounded table. A run is cut into the tokenizer's pre-tokens. A pre-token of more than ``LEAF`` symbols is encoded
as a tree: its leaves on their own, in parallel, then joined in pairs; around a join a window is encoded anew and
grows until it begins and ends with tokens that both sides have at those places. BPE encodings fit together there:
whether two tokens may stand side by side depends on those two alone, and each such pair has then been found
by an encoder. Special tokens are cut out first and the text between them is normalised, as the library does; every
text takes this way.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
import struct
import sys
import unicodedata
from array import array
from collections.abc import Callable, Iterator
from concurrent.futures import ThreadPoolExecutor
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches, table

#: Symbols of a leaf of the tree, and of the first window on each side of a join.
LEAF, REACH = 48, 24
#: Runs kept in a worker's table before it starts again, and the letters of the longest one kept: bounds on memory, not on
#: what is encoded.
KEPT_RUNS, KEPT_LETTERS = 300_000, 48
#: Leaves from which threads encode them.
THREADED = 256


#: White space as the tokenizer's patterns have it; Python's own class also holds the four separators of ``ODD``.
SPACE = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]+")
ODD = frozenset("\x1c\x1d\x1e\x1f")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level BPE."""
    own = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    rest = iter(range(256, 512))
    return [chr(b) if b in own else chr(next(rest)) for b in range(256)]


class TreeEncoder:
    """Encodes one pre-token of any length, given as symbols.

    ``inner`` encodes a string as if more followed, ``final`` one that ends the pre-token; both give ids.
    ``width`` tells how many symbols a token covers.
    """

    def __init__(self, inner: Callable[[str], list[int]], final: Callable[[str], list[int]], width: list[int], leaf: int = LEAF, reach: int = REACH) -> None:
        self.inner, self.final, self.width, self.leaf, self.reach = inner, final, width, leaf, reach

    def encode(self, s: str) -> list[int]:
        if len(s) <= self.leaf:
            return self.final(s)
        ends = list(range(self.leaf, len(s), self.leaf)) + [len(s)]
        spans = list(zip([0, *ends], ends, strict=False))
        one = lambda p: self._part(s, *p)
        if len(spans) >= THREADED:
            with ThreadPoolExecutor(min(4, os.cpu_count() or 1)) as pool:
                ids = list(pool.map(one, spans, chunksize=64))
        else:
            ids = [one(p) for p in spans]
        nodes = [(a, b, x) for (a, b), x in zip(spans, ids, strict=True)]
        while len(nodes) > 1:
            paired = [self._join(s, *nodes[i], *nodes[i + 1]) for i in range(0, len(nodes) - 1, 2)]
            nodes = paired + nodes[len(nodes) - len(nodes) % 2 :]
        return nodes[0][2]

    def _part(self, s: str, a: int, b: int) -> list[int]:
        return self.final(s[a:b]) if b == len(s) else self.inner(s[a:b])

    def _join(self, s: str, a: int, m: int, left: list[int], m2: int, b: int, right: list[int]) -> tuple[int, int, list[int]]:
        """left covers s[a:m], right s[m:b]. The window grows on a side until its outermost token agrees there."""
        l_at = self._starts(a, left)
        r_at = [*self._starts(m, right), b]
        reach_l = reach_r = self.reach
        while True:
            i = max(0, int(np.searchsorted(l_at, m - reach_l, side="right")) - 1)
            j = min(len(right), int(np.searchsorted(r_at, m + reach_r, side="left")))
            lo, hi = l_at[i], r_at[j]
            mid = self._part(s, lo, hi)
            fits_l = i == 0 or mid[0] == left[i]
            fits_r = j == len(right) or mid[-1] == right[j - 1]
            if fits_l and fits_r:
                return a, b, left[:i] + mid + right[j:]
            if not fits_l:
                reach_l *= 2
            if not fits_r:
                reach_r *= 2

    def _starts(self, at: int, ids: list[int]) -> list[int]:
        out = []
        for x in ids:
            out.append(at)
            at += self.width[x]
        return out


class Codec:
    """Encodes to and decodes from the ids of one tokenizer file of the word-end BPE kind.

    The normaliser must be NFC, white space to blanks and lower case; the pre-tokenizer a split by pattern with
    byte symbols, as in that kind's files; anything else raises ValueError.
    """

    def __init__(self, path: str, leaf: int = LEAF) -> None:
        import regex
        from tokenizers import Tokenizer, models

        if sys.byteorder != "little" or array("I").itemsize != 4:
            raise RuntimeError("ids are laid out on a little-endian machine with 32-bit integers")
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        with open(path, encoding="utf-8") as f:
            told = json.load(f)
        split = told["pre_tokenizer"]["pretokenizers"][0]
        kinds = [n["type"] for n in told["normalizer"]["normalizers"]]
        suffix = told["model"].get("end_of_word_suffix")
        if kinds != ["NFC", "Replace", "Lowercase"] or not split.get("invert") or told.get("decoder") or not suffix:
            raise ValueError(f"{path}: not a word-end BPE file of the known kind")
        self.library = Tokenizer.from_file(path)
        self.library.no_padding()
        self.library.no_truncation()
        self.pattern = regex.compile(split["pattern"]["Regex"])
        self.symbols = byte_symbols()
        vocab = told["model"]["vocab"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in told["model"]["merges"]]
        size = max([*vocab.values(), *(a["id"] for a in told["added_tokens"])]) + 1
        self.pieces = [""] * size
        for t, i in [*vocab.items(), *((a["content"], a["id"]) for a in told["added_tokens"])]:
            self.pieces[i] = t
        width = [len(t.removesuffix(suffix)) for t in self.pieces]
        inner = models.BPE(vocab=vocab, merges=[m for m in merges if not m[1].endswith(suffix)])
        final = self.library.model
        self.tree = TreeEncoder(lambda s: [t.id for t in inner.tokenize(s)], lambda s: [t.id for t in final.tokenize(s)], width, leaf)
        if any(a["normalized"] or a["lstrip"] or a["rstrip"] or a["single_word"] for a in told["added_tokens"]):
            raise ValueError(f"{path}: added tokens that depend on what is around them")
        self.special = {a["content"]: struct.pack("<I", a["id"]) for a in told["added_tokens"]}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.runs: dict[str, bytes] = {}
        self.decoded: dict[str, str] = {}

    def word(self, piece: str) -> list[int]:
        """The ids of one pre-token."""
        return self.tree.encode("".join([self.symbols[b] for b in piece.encode("utf-8")]))

    def _run(self, run: str) -> bytes:
        base = run[:-1]
        if run[-1] in ",." and base.isalpha():
            ids = (self.runs.get(base) or self._word_bytes(base)) + (self.runs.get(run[-1]) or self._run(run[-1]))
        elif run.isalpha():
            ids = self._word_bytes(run)
        else:
            ids = array("I", [i for p in self.pattern.findall(run) for i in self.word(p)]).tobytes()
        if len(run) <= KEPT_LETTERS:
            if len(self.runs) >= KEPT_RUNS:
                self.runs.clear()
            self.runs[run] = ids
        return ids

    def _word_bytes(self, letters: str) -> bytes:
        """Letters alone are one pre-token; ASCII ones are their own symbols."""
        return array("I", self.tree.encode(letters) if letters.isascii() else self.word(letters)).tobytes()

    def encode(self, text: str) -> bytes:
        """The ids of a whole text, as little-endian unsigned 32-bit integers one after another."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        return b"".join([self.special.get(x) or self._plain(x) for x in self.cut.split(text)])

    def _plain(self, text: str) -> bytes:
        """The ids of text without special tokens: composed, lower-cased letter by letter, run by run."""
        if not text.isascii():
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            text = text.replace("Σ", "σ")  # Python alone would look where in a word it stands
        low = text.lower()
        get, own = self.runs.get, self._run
        return b"".join([get(r) or own(r) for r in (low.split() if ODD.isdisjoint(low) else SPACE.sub(" ", low).strip(" ").split(" ")) if r])

    def decode(self, ids: bytes) -> str:
        """What the library's decode gives without a decoder: the pieces with blanks between, special ones too."""
        pieces = self.pieces
        return " ".join([pieces[i] for i in np.frombuffer(ids, dtype="<u4").tolist()])


@lru_cache(maxsize=4)
def codec(path: str) -> Codec:
    """One codec for each worker process; its table outlives tasks."""
    return Codec(path)


def encode_decode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """(doc_id, ids, decoded): the ids as little-endian 32-bit integers and the text they decode to.

    A null text is the empty text (no ids, an empty decoded text). Null doc_ids and repeated rows keep their
    rows; an empty table gives none; other columns, whatever their names, play no part. A very long text is one row;
    its runs are encoded one by one, and an unsplit run of any length as a tree.
    """
    return _mapped(docs, path, "doc_id long, ids binary, decoded string", lambda ids, text: (ids, text), [pa.binary(), pa.string()])


def _mapped(docs: DataFrame, path: str | None, schema: str, of: Callable[[bytes, str], tuple], kinds: list[pa.DataType]) -> DataFrame:
    path = path or default_path()
    names = [f.split()[0] for f in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c = codec(path)
        for b in batches:
            rows = []
            for x in b.column(1):
                ids = c.encode(x.as_py() or "")
                rows.append(of(ids, c.decode(ids)))
            cols = [pa.array(v, k) for v, k in zip(zip(*rows, strict=True) if rows else [[] for _ in kinds], kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], names=names)

    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(run, schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op6: counts and digests of the ids and of the decoded text; the digests are taken where the ids are made."""

    def of(ids: bytes, text: str) -> tuple:
        return len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(text.encode("utf-8")).hexdigest()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return _mapped(table(spark, sf_dir, "documents"), None, schema, of, [pa.int64(), pa.string(), pa.string()])
