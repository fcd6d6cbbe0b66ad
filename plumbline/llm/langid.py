"""Language ID (5): script ranges narrow the candidates, Viterbi over words labels spans.

A word's score for a language is the log probability of its letter pairs and triples there. Each script has the
languages that were seen writing it; the others are no candidates for its words. Over a text the best path pays
``SWITCH`` whenever the language changes, so a stray word changes nothing and a foreign passage is a span of its
own. The path is found in blocks of words: a block's best scores from every entry to every exit language come
for many blocks at once, as many as ``ROOM`` allows whatever the number of languages, then blocks are chained, then each
block is walked back. Words of a script that no language was seen to write have no vote and no place on the path.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.llm.common import small_batches, table

UNKNOWN = "und"
#: About so many labelled documents of a language, chosen by a hash of doc_id, are learned from; all if there are fewer.
SAMPLE_DOCS = 2000
#: The price of a change of language, in nats.
SWITCH = 8.0
#: Words of a block, entries of a worker's word table, letters of the longest word kept there.
BLOCK, KEPT_WORDS, KEPT_LETTERS = 64, 400_000, 64
#: Cells (word, entry, language) that are worked on at once.
ROOM = 1 << 25
#: A language writes a script if at least this share of its words does.
WRITES = 0.005
NO_CANDIDATE = -60.0

#: First and last code points of scripts in Unicode's blocks.
SCRIPTS = [
    ("Latin", 0x0041, 0x024F), ("Latin", 0x1E00, 0x1EFF), ("Greek", 0x0370, 0x03FF), ("Greek", 0x1F00, 0x1FFF),
    ("Cyrillic", 0x0400, 0x052F), ("Armenian", 0x0530, 0x058F), ("Hebrew", 0x0590, 0x05FF), ("Arabic", 0x0600, 0x06FF),
    ("Arabic", 0x0750, 0x077F), ("Devanagari", 0x0900, 0x097F), ("Bengali", 0x0980, 0x09FF), ("Gurmukhi", 0x0A00, 0x0A7F),
    ("Gujarati", 0x0A80, 0x0AFF), ("Tamil", 0x0B80, 0x0BFF), ("Telugu", 0x0C00, 0x0C7F), ("Kannada", 0x0C80, 0x0CFF),
    ("Malayalam", 0x0D00, 0x0D7F), ("Sinhala", 0x0D80, 0x0DFF), ("Thai", 0x0E00, 0x0E7F), ("Lao", 0x0E80, 0x0EFF),
    ("Myanmar", 0x1000, 0x109F), ("Georgian", 0x10A0, 0x10FF), ("Hangul", 0x1100, 0x11FF), ("Ethiopic", 0x1200, 0x137F),
    ("Khmer", 0x1780, 0x17FF), ("Kana", 0x3040, 0x30FF), ("Han", 0x3400, 0x4DBF), ("Han", 0x4E00, 0x9FFF), ("Hangul", 0xAC00, 0xD7A3),
]

#: Blocks of combining marks, which stand inside words.
MARKS = "\u0300-\u036f\u0483-\u0487\u0591-\u05c7\u0610-\u061a\u064b-\u065f\u0670\u06d6-\u06ed\u0900-\u0903\u093a-\u094f\u0951-\u0957\u0962\u0963\u0981-\u0983\u09bc-\u09cd\u0a01-\u0a03\u0a3c-\u0a4d\u0a81-\u0a83\u0abc-\u0acd\u0b82\u0bbe-\u0bcd\u0c00-\u0c04\u0c3e-\u0c56\u0c81-\u0c83\u0cbc-\u0cd6\u0d00-\u0d03\u0d3b-\u0d4d\u0d82\u0d83\u0dca-\u0ddf\u0e31\u0e34-\u0e3a\u0e47-\u0e4e\u0eb1\u0eb4-\u0ebc\u0ec8-\u0ecd\u102b-\u103e\u135d-\u135f\u17b4-\u17d3\u200c\u200d\u3099\u309a"
WORD = re.compile(r"[^\W\d_]+")
MARKED = re.compile(rf"[^\W\d_](?:[^\W\d_]|[{MARKS}])*")
MARK = re.compile(f"[{MARKS}]")


def pattern(text: str) -> re.Pattern:
    """The pattern of the words of a text; the slower one where marks stand in it."""
    return WORD if text.isascii() or not MARK.search(text) else MARKED


def find_words(text: str) -> list[str]:
    """The words of a lower-case text, composed, so that one written with marks is the same as one without."""
    if text.isascii() or not MARK.search(text):
        return WORD.findall(text)
    return [unicodedata.normalize("NFC", w) for w in MARKED.findall(text)]


def script(word: str) -> str:
    """The script of a word's first letter; '' outside the ranges."""
    c = ord(word[0])
    return next((s for s, a, b in SCRIPTS if a <= c <= b), "")


def has_letter(word: str) -> bool:
    return word.isalpha() or any(map(str.isalpha, word))


def grams(word: str) -> list[str]:
    w = f"<{word}>"
    return [w[i : i + 2] for i in range(len(w) - 1)] + [w[i : i + 3] for i in range(len(w) - 2)]


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training; a null id is not held out, yet nothing is learned from it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 5 == 0, F.lit(False))


@dataclass
class Model:
    """languages in order of name; a row of log probabilities for each gram; each script's candidates."""

    languages: list[str]
    rows: dict[str, int]
    table: np.ndarray
    scripts: dict[str, np.ndarray]
    prior: np.ndarray


def fit(docs: DataFrame, sample_docs: int = SAMPLE_DOCS) -> Model:
    """Learn from ``docs`` (doc_id, text, lang): rows with a text, a language and an id that isn't held out.

    A language's documents are taken with the probability that brings about ``sample_docs``, by a hash of the
    id: the same whatever the partitions. Counting runs on the executors; what the driver gets is grams.
    """
    known = docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull())
    size = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not size:
        return Model([], {}, np.zeros((0, 0), np.float32), {}, np.zeros(0))
    languages = sorted(size)
    share = F.coalesce(*[F.when(F.col("lang") == x, F.lit(min(1.0, sample_docs / size[x]))) for x in languages])
    chosen = known.where(F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) < share * (1 << 30))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                words.setdefault(lang, Counter()).update(w for w in find_words(text.lower()) if has_letter(w))
            found: Counter = Counter()
            for lang, own in words.items():
                for w, n in own.items():
                    found[lang, "script", script(w)] += n
                    for g in grams(w):
                        found[lang, "gram", g] += n
            cols = list(zip(*[(*k, n) for k, n in found.items()], strict=True)) or [[], [], [], []]
            yield pa.RecordBatch.from_arrays([*(pa.array(c, pa.string()) for c in cols[:3]), pa.array(cols[3], pa.int64())], names=["lang", "kind", "what", "n"])

    small_batches(docs.sparkSession)
    counted = chosen.select(F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(run, "lang string, kind string, what string, n long")
    rows = counted.groupBy("lang", "kind", "what").agg(F.sum("n").alias("n")).collect()
    number = {x: i for i, x in enumerate(languages)}
    names = sorted({r["what"] for r in rows if r["kind"] == "gram"})
    index = {g: i for i, g in enumerate(names)}
    n = np.zeros((len(names) + 1, len(languages)))
    written: dict[str, np.ndarray] = {}
    for r in rows:
        to = number[r["lang"]]
        if r["kind"] == "gram":
            n[index[r["what"]], to] = r["n"]
        else:
            written.setdefault(r["what"], np.zeros(len(languages)))[to] = r["n"]
    triple = np.array([len(g) == 3 for g in names] + [True])
    logs = np.zeros_like(n)
    for kind in (triple, ~triple):
        logs[kind] = np.log((n[kind] + 0.5) / (n[kind].sum(axis=0) + 0.5 * kind.sum()))
    logs[-1] = logs[-1].mean()  # an unseen gram speaks for no language
    total = sum(written.values()) + 1e-9
    return Model(languages, index, (logs / 2).astype(np.float32), {s: c / total >= WRITES for s, c in written.items()}, np.array([size[x] for x in languages], float))


class Labeller:
    """Labels texts by a model; keeps the scores of recurring words.

    A word's number is its row of ``scores``: 0 for what holds no letter, 1 for a word that has no vote.
    """

    def __init__(self, model: Model, switch: float = SWITCH, room: int = ROOM) -> None:
        self.model, self.switch, self.room = model, switch, room
        self._forget()

    def _forget(self) -> None:
        self.known: dict[str, int] = {}
        self.used = 2
        self.scores = np.zeros((1024, len(self.model.languages)), np.float32)

    def _learn(self, words: list[str]) -> dict[str, int]:
        """Number and score words not met before; a long one is not kept beyond the batch."""
        m, of, get = self.model, len(self.model.rows), self.model.rows.get
        votes: dict[str, np.ndarray | None] = {}
        for w in words:
            s = script(w)
            if s not in votes:
                may = m.scripts.get(s)
                votes[s] = None if may is None or not may.any() else np.where(may, 0, NO_CANDIDATE).astype(np.float32)
        numbers = {w: 1 for w in words if votes[script(w)] is None}
        words = [w for w in words if w not in numbers]
        if words:
            at = self.used
            if at + len(words) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros((max(len(self.scores), len(words)), self.scores.shape[1]), np.float32)])
            every = [[get(g, of) for g in grams(w)] for w in words]
            starts = np.cumsum([0, *map(len, every)])[:-1]
            got = np.add.reduceat(m.table[[i for x in every for i in x]], starts, axis=0)
            got += np.array([votes[script(w)] for w in words]) - got.max(axis=1, keepdims=True)
            self.scores[at : at + len(words)] = got
            self.used += len(words)
            numbers |= {w: at + k for k, w in enumerate(words)}
        self.known |= {w: n for w, n in numbers.items() if len(w) <= KEPT_LETTERS}
        return numbers

    def numbers(self, texts: list[str]) -> list[np.ndarray]:
        """The numbers of each text's words, in order; those without a letter left out."""
        found = [find_words(t.lower()) for t in texts]
        if len(self.known) > KEPT_WORDS or self.used > 2 * KEPT_WORDS:
            self._forget()
        new = {w for ws in found for w in ws if w not in self.known}
        none = {w for w in new if not has_letter(w)}
        now = self._learn(sorted(new - none)) if new - none else {}
        get = self.known.get
        out = [np.array([get(w) or now.get(w, 0) for w in ws], dtype=np.int32) for ws in found]
        return [x[x > 0] for x in out]

    def paths(self, numbers: list[np.ndarray]) -> list[np.ndarray]:
        """The best language of every word of every text, words that have a vote."""
        most = max(1, self.room // (BLOCK * max(1, len(self.model.languages)) ** 2))
        out: list[np.ndarray] = []
        group: list[np.ndarray] = []
        held = 0
        for x in numbers:
            blocks = -(-len(x) // BLOCK)
            if blocks > most:
                out += self._group(group) + [self._long(x, most * BLOCK)]
                group, held = [], 0
                continue
            if held + blocks > most:
                out += self._group(group)
                group, held = [], 0
            group.append(x)
            held += blocks
        return out + self._group(group)

    def _long(self, x: np.ndarray, size: int) -> np.ndarray:
        """The path of one long text, in stretches: scores forward, then each stretch again from the last one back."""
        n = len(self.model.languages)
        parts = [x[i : i + size] for i in range(0, len(x), size)]
        at = [np.zeros(n, np.float32)]
        for k, p in enumerate(parts[:-1]):
            at.append(self._solve([p], at[-1][None], first=not k)[1][0])
        labels: list[np.ndarray] = []
        out = None
        for k in range(len(parts) - 1, -1, -1):
            own, _, out = self._solve([parts[k]], at[k][None], first=not k, exits=out)
            labels.append(own[0])
        return np.concatenate(labels[::-1])

    def _group(self, numbers: list[np.ndarray]) -> list[np.ndarray]:
        if not sum(map(len, numbers)):
            return [np.zeros(0, np.int16) for _ in numbers]
        return self._solve(numbers, np.zeros((len(numbers), len(self.model.languages)), np.float32), first=True)[0]

    def _solve(self, numbers: list[np.ndarray], at: np.ndarray, first: bool, exits: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray, np.ndarray]:
        """(labels, best scores at the end, languages entered from) of texts that are entered with the scores ``at``.

        ``first`` says that the texts begin here, where any language starts for nothing; ``exits`` fixes their last languages.
        """
        n_lang = len(self.model.languages)
        blocks = [-(-len(x) // BLOCK) for x in numbers]
        total = sum(blocks)
        start = np.cumsum([0, *blocks])
        flat = np.zeros(total * BLOCK, np.int32)
        length = np.full(total, BLOCK)
        for x, a, b in zip(numbers, start[:-1], blocks, strict=True):
            if b:
                flat[a * BLOCK : a * BLOCK + len(x)] = x
                length[a + b - 1] = len(x) - (b - 1) * BLOCK
        score = self.scores[flat].reshape(total, BLOCK, n_lang)
        score[flat.reshape(total, BLOCK) == 0] = 0
        lam = np.float32(self.switch)
        same = np.eye(n_lang, dtype=bool)
        best = np.where(same, 0, -lam).astype(np.float32)[None] + score[:, 0, None, :]  # block, entry, language
        stay = np.ones((BLOCK, total, n_lang, n_lang), bool)
        whence = np.zeros((BLOCK, total, n_lang), np.int16)
        for t in range(1, BLOCK):
            whence[t] = best.argmax(axis=2)
            moved = best.max(axis=2, keepdims=True) - lam
            keep = best >= moved
            keep[length <= t] = True  # past a block's words nothing changes
            stay[t] = keep
            best = np.where(keep, best, moved) + score[:, t, None, :]
        # chain blocks: the k-th block of every text at once
        ends, back = np.zeros(total, np.int16), np.zeros((total, n_lang), np.int16)
        counts = np.array(blocks)
        texts = np.flatnonzero(counts)
        at = at.copy()
        for k in range(counts.max()):
            live = texts[counts[texts] > k]
            rows = start[live] + k
            through = best[rows] + np.where(same, 0, NO_CANDIDATE * 100).astype(np.float32) if first and not k else at[live][:, :, None] + best[rows]
            back[rows] = through.argmax(axis=1)
            at[live] = through.max(axis=1)
        entry = np.zeros(total, np.int16)
        out = at.argmax(axis=1) if exits is None else exits
        for k in range(counts.max() - 1, -1, -1):
            live = texts[counts[texts] > k]
            rows = start[live] + k
            ends[rows] = out[live]
            entry[rows] = back[rows, out[live]]
            out[live] = entry[rows]
        # walk every block back from its exit
        labels, now, every = np.zeros((total, BLOCK), np.int16), ends.astype(np.int64), np.arange(total)
        for t in range(BLOCK - 1, -1, -1):
            labels[:, t] = now
            if t:
                now = np.where(stay[t, every, entry, now], now, whence[t, every, entry])
        flat_labels = labels.reshape(-1)
        return [flat_labels[a * BLOCK : a * BLOCK + len(x)] for x, a in zip(numbers, start[:-1], strict=True)], at, out

    def label(self, texts: list[str]) -> list[tuple[str, float, list[tuple[int, int, str]]]]:
        """(language, share of the words with a letter that are its on the path, spans of characters) for each text."""
        languages = self.model.languages
        if not languages:
            return [(UNKNOWN, 0.0, []) for _ in texts]
        every = self.numbers(texts)
        numbers = [x[x > 1] for x in every]
        out = []
        for text, whole, own, path in zip(texts, every, numbers, self.paths(numbers), strict=True):
            if not len(whole):
                out.append((UNKNOWN, 0.0, []))
                continue
            if not len(path):  # letters, but of no script that was learned: all that is known is what is frequent
                out.append((languages[int(self.model.prior.argmax())], 0.0, []))
                continue
            n = np.bincount(path, minlength=len(languages))
            top = np.flatnonzero(n == n.max())
            if len(top) > 1:
                top = top[np.argsort(-self.scores[own].sum(axis=0)[top] - 1e-9 * self.model.prior[top], kind="stable")]
            changes = np.flatnonzero(np.diff(path)) + 1
            if len(changes):
                low = text.lower()
                at = [m.start() for m in pattern(low).finditer(low) if has_letter(m[0])] if len(low) == len(text) else _starts(text)
                at = np.array(at)[whole > 1]
                places = [0, *(int(at[i]) for i in changes), len(text)]
            else:
                places = [0, len(text)]
            spans = [(a, b, languages[path[i]]) for a, b, i in zip(places, places[1:], [0, *changes], strict=False)]
            out.append((languages[top[0]], float(n[top[0]]) / len(whole), spans))
        return out


def _starts(text: str) -> list[int]:
    """Where the words start if lower-casing changes the length: counted letter by letter."""
    ends, n = [], 0
    for c in text:
        n += len(c.lower())
        ends.append(n)
    low = text.lower()
    return [int(np.searchsorted(ends, m.start(), side="right")) for m in pattern(low).finditer(low) if has_letter(m[0])]


SPANS = "array<struct<start:int,end:int,lang:string>>"


def identify(docs: DataFrame, model: Model, switch: float = SWITCH) -> DataFrame:
    """``docs`` with lang_pred, lang_score and lang_spans appended (replacing columns of those names).

    A null text, or one without a letter, is 'und' with score 0 and no spans; so is every text if the model
    learned no language. Words of a script that no language was seen to write count for none; a text of such words
    alone gets the most frequent language with score 0 and no spans. Ties go to the language with the higher sum of
    scores, then the more frequent one, then by name. Repeated rows and null ids keep their rows; an empty table gives
    none. Other columns may have any name. A very long text is read whole, its path found in stretches.
    """
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    new = ("lang_pred", "lang_score", "lang_spans")
    docs = docs.drop(*new)
    kept = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labeller = Labeller(shared.value, switch)
        kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("lang", pa.string())]))
        for b in batches:
            found = labeller.label([x or "" for x in b.column(kept.index("text")).to_pylist()])
            spans = [[{"start": s, "end": e, "lang": x} for s, e, x in f[2]] for f in found]
            cols = [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64()), pa.array(spans, kind)]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*kept, *new])

    small_batches(spark)
    fields = ", ".join(f"`{f.name.replace('`', '``')}` {f.dataType.simpleString()}" for f in docs.schema.fields)
    return docs.mapInArrow(run, f"{fields}, lang_pred string, lang_score double, lang_spans {SPANS}")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """op5: the language of every document, from a model of those that aren't held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit(docs))
    return found.select("doc_id", held_out().alias("held_out"), "lang_pred", F.col("lang_score").alias("score"), F.size("lang_spans").alias("n_spans"))
