"""Token counts (9) under edits: a segment tree over each document's pre-tokens.

A segment is a pre-token of the tokenizer's pattern, so a document's count is the sum of its segments' counts. A document
keeps a tree of sums over leaves of ``LEAF`` segments: ``plant`` makes it a row of a table (characters, tokens and segments of
each leaf, a few bytes for each hundred of text), ``graft`` joins texts and an edits table to those rows and gives the new
ones. An edit replaces the characters from ``start`` to ``end``. From the leaf before the one it touches, text is split anew
until a cut falls where a leaf ended before, beyond the edit; those leaves alone are encoded anew and replaced, and only sums
above them are recomputed. Nothing else of the text is split or encoded again.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import cut, small_batches, table

#: Segments of a leaf; leaves of a node.
LEAF, FAN = 64, 8
#: Segments kept in a worker's table before it starts again, and the letters of the longest one kept.
KEPT_SEGMENTS, KEPT_LETTERS = 300_000, 48


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken")


class Counter:
    """Tokens of a segment; recurring ones from a bounded table."""

    def __init__(self, path: str) -> None:
        import public_tokenizers
        import regex
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.encoding = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.split = regex.compile(public_tokenizers.PATTERN).findall
        self.known: dict[str, int] = {}

    def __call__(self, segments: list[str]) -> list[int]:
        get, own = self.known.get, self._count
        return [get(s) or own(s) for s in segments]

    def _count(self, segment: str) -> int:
        n = len(self.encoding._encode_single_piece(segment))
        if len(segment) <= KEPT_LETTERS:
            if len(self.known) >= KEPT_SEGMENTS:
                self.known.clear()
            self.known[segment] = n
        return n


@lru_cache(maxsize=4)
def counter(path: str) -> Counter:
    return Counter(path)


class CountTree:
    """The leaves of a text, with sums of characters and tokens above them; ``encoded`` counts the segments ever encoded for it.

    ``kept`` holds the (characters, tokens, segments) of each leaf if they are known; then nothing is encoded.
    """

    def __init__(self, text: str, count: Counter, kept: tuple[list[int], list[int], list[int]] | None = None) -> None:
        self.count, self.encoded = count, 0
        if kept is None:
            self.leaves, self.chars, self.tokens, self.sizes = self._made(count.split(text))
        else:
            self.chars, self.tokens, self.sizes = map(list, kept)
            if sum(self.chars) != len(text):
                raise ValueError("the tree is of another text")
            ends = list(accumulate(self.chars))
            self.leaves = [text[e - n : e] for e, n in zip(ends, self.chars, strict=True)]
        self.levels: list[tuple[list[int], list[int]]] = []
        self._raise(0)

    @property
    def segments(self) -> int:
        return sum(self.sizes)

    @property
    def text(self) -> str:
        return "".join(self.leaves)

    def _made(self, segments: list[str]) -> tuple[list[str], list[int], list[int], list[int]]:
        """(texts, characters, tokens, segments) of leaves."""
        counts = self.count(segments)
        self.encoded += len(segments)
        at = range(0, len(segments), LEAF)
        texts = ["".join(segments[i : i + LEAF]) for i in at]
        return texts, list(map(len, texts)), [sum(counts[i : i + LEAF]) for i in at], [len(segments[i : i + LEAF]) for i in at]

    def _raise(self, first: int) -> None:
        """Rebuild the sums above the leaves from leaf ``first`` on; nodes before it keep theirs."""
        kept = self.levels
        self.levels, c, t, at = [], self.chars, self.tokens, first
        while len(c) > 1:
            at //= FAN
            old = kept[len(self.levels)] if len(self.levels) < len(kept) else ([], [])
            at = min(at, len(old[0]))
            c2 = old[0][:at] + [sum(c[i : i + FAN]) for i in range(at * FAN, len(c), FAN)]
            t2 = old[1][:at] + [sum(t[i : i + FAN]) for i in range(at * FAN, len(t), FAN)]
            self.levels.append((c2, t2))
            c, t = c2, t2
        self.total_chars, self.total = (c[0], t[0]) if c else (0, 0)

    def _leaf_at(self, offset: int) -> tuple[int, int]:
        """The leaf that holds the character at ``offset`` (the last leaf for the end), and where it starts."""
        low, high, node, start = 0, 1, 0, 0
        for c in [*(x for x, _ in reversed(self.levels)), self.chars]:
            node = low
            while node < min(high, len(c)) - 1 and start + c[node] <= offset:
                start += c[node]
                node += 1
            low, high = node * FAN, node * FAN + FAN
        return node, start

    def edit(self, start: int, end: int, new: str) -> int:
        """Replace the characters from start to end (clipped to the text) by ``new``; returns the new total."""
        start = min(max(0, start), self.total_chars)
        end = min(max(start, end), self.total_chars)
        if not self.leaves:
            self.leaves, self.chars, self.tokens, self.sizes = self._made(self.count.split(new))
            self._raise(0)
            return self.total
        a, at = self._leaf_at(max(0, start - 1))
        if a:  # what stands before the edit may split otherwise with it
            a -= 1
            at -= self.chars[a]
        b, far = self._leaf_at(end)[0], 1
        while True:
            b, far = min(b + far, len(self.leaves) - 1), far * 2
            last = b == len(self.leaves) - 1
            text = "".join(self.leaves[a : b + 1])
            fresh = self.count.split(text[: start - at] + new + text[end - at :])
            moved = len(new) - (end - start)
            # where leaves ended beyond the edit, but for the last one read here: the text behind it could matter there
            ends = list(accumulate(self.chars[a : b + 1]))
            old = {e + moved: a + i for i, e in enumerate(ends[: None if last else -1]) if e > end - at or e == len(text)}
            met = next(((k, old[e]) for k, e in enumerate(accumulate(map(len, fresh)), 1) if e in old), None)
            if met or last:
                break
        take, b = met or (len(fresh), b)
        texts, chars, tokens, sizes = self._made(fresh[:take])
        same = len(texts) == b + 1 - a
        self.leaves[a : b + 1], self.chars[a : b + 1], self.tokens[a : b + 1], self.sizes[a : b + 1] = texts, chars, tokens, sizes
        self._climb(a, b) if same else self._raise(a)
        return self.total

    def _climb(self, a: int, b: int) -> None:
        """The number of leaves is as before: only the sums above leaves a to b change."""
        c, t = self.chars, self.tokens
        for c2, t2 in self.levels:
            a, b = a // FAN, b // FAN
            for i in range(a, b + 1):
                c2[i], t2[i] = sum(c[i * FAN : i * FAN + FAN]), sum(t[i * FAN : i * FAN + FAN])
            c, t = c2, t2
        self.total_chars, self.total = (c[0], t[0]) if c else (0, 0)


TREE = "n_tokens long, n_segments long, chars array<int>, tokens array<int>, sizes array<int>"
COUNTED = "doc_id long, n_tokens_before long, n_segments_before long, n_edits int, n_tokens long, n_segments long, segments_encoded long"
INTS = pa.list_(pa.int32())


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")).withColumn("th", F.xxhash64("text"))


def plant(docs: DataFrame, path: str | None = None) -> DataFrame:
    """The trees of ``docs`` (doc_id, text), a row each, for the caller to keep as a table; th, a hash, tells a doc_id's texts apart.

    A null text is the empty text. Null doc_ids and repeated rows keep their rows; an empty table gives none; other columns,
    whatever their names, play no part. A very long text is one row.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        for b in batches:
            trees = [CountTree(x.as_py(), count) for x in b.column(1)]
            cols = [b.column(0), b.column(2), pa.array([t.total for t in trees], pa.int64()), pa.array([t.segments for t in trees], pa.int64()), *(pa.array([getattr(t, c) for t in trees], INTS) for c in ("chars", "tokens", "sizes"))]
            yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "th", "n_tokens", "n_segments", "chars", "tokens", "sizes"])

    small_batches(docs.sparkSession)
    return _texts(docs).mapInArrow(run, f"doc_id long, th long, {TREE}")


def graft(docs: DataFrame, trees: DataFrame, edits: DataFrame, path: str | None = None, grown: bool = True) -> DataFrame:
    """A row for each row of ``docs`` with its counts before and after ``edits`` (doc_id, edits), by the kept ``trees``.

    ``edits.edits`` is an array of structs (at long, until long, put string), applied one after another, each to the
    text that those before it left; offsets count characters and are clipped to the text. A document without a row of edits
    stays as it is, and so does one without an id; a null edit or offset changes nothing and a null ``put`` deletes. Rows of
    edits that share a doc_id are applied to copies of the document. A text that has no tree raises ValueError.
    With ``grown`` the rows also hold the new text and the columns of its tree, to be kept in place of the old ones.
    """
    path = path or default_path()
    more = f", text string, th long, {TREE.split(', ', 2)[2]}" if grown else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path)
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), *([pa.string(), INTS, INTS, INTS] if grown else [])]
        for b in batches:
            rows = []
            for doc_id, text, chars, tokens, sizes, own in zip(b.column(0).to_pylist(), b.column(1), *(c.to_pylist() for c in b.columns[2:]), strict=True):
                if chars is None:
                    raise ValueError(f"document {doc_id}: no tree was planted for this text")
                tree, done = CountTree(text.as_py(), count, (chars, tokens, sizes)), 0
                n, segments = tree.total, tree.segments
                for e in own or []:
                    if e is not None and e["at"] is not None and e["until"] is not None:
                        tree.edit(e["at"], e["until"], e["put"] or "")
                        done += 1
                rows.append((doc_id, n, segments, done, tree.total, tree.segments, tree.encoded, *((tree.text, tree.chars, tree.tokens, tree.sizes) if grown else ())))
            cols = zip(*rows, strict=True) if rows else [[] for _ in kinds]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(cols, kinds, strict=True)], names=names)

    small_batches(docs.sparkSession)
    schema = (COUNTED + more).replace(", th long", "")
    names = [f.split()[0] for f in schema.split(", ")]
    told = edits.select(F.col("doc_id").cast("long").alias("e"), F.col("edits").cast("array<struct<at:long,until:long,put:string>>").alias("edits"))
    # trees and edits are small; texts, which are not, are shuffled once
    work = trees.select(F.col("doc_id").alias("d"), F.col("th").alias("h"), "chars", "tokens", "sizes").dropDuplicates(["d", "h"])
    work = work.join(told, F.col("d") == F.col("e"), "left").drop("e")
    texts = _texts(docs)
    both = texts.join(work, texts["doc_id"].eqNullSafe(F.col("d")) & (texts["th"] == F.col("h")), "left")
    out = both.select("doc_id", "text", "chars", "tokens", "sizes", "edits").mapInArrow(run, schema)
    return out.withColumn("th", F.xxhash64("text")) if grown else out


def standard_edits(docs: DataFrame) -> DataFrame:
    """(doc_id, edits) with three edits for each id: a word in front, a cut of 40 characters from the middle, a line at the end.

    Of rows that share a doc_id the longest text tells the places.
    """
    n = F.max(F.coalesce(F.char_length("text"), F.lit(0)).cast("long")).alias("n")
    n, rows = F.col("n"), docs.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(n)
    edit = lambda a, b, s: F.struct(a.cast("long").alias("at"), b.cast("long").alias("until"), F.lit(s).alias("put"))
    middle = F.floor(n / 2)
    return rows.select("doc_id", F.array(edit(F.lit(0), F.lit(0), "Revised "), edit(middle, middle + 40, "x"), edit(n + 8, n + 8, "\nEnd of text.")).alias("edits"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op9: counts of every whole document before and after the standard edits, from kept trees."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    trees = cut(plant(docs), "trees")
    out = graft(docs, trees, standard_edits(docs), grown=False)
    return out.select("doc_id", F.col("n_tokens_before").alias("n_tokens"), F.col("n_segments_before").alias("n_segments"), "n_edits", F.col("n_tokens").alias("n_tokens_edited"), "segments_encoded")
