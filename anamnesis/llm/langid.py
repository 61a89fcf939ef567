"""Language identification of mixed-language text.

A word's script (by code point ranges) leaves only the languages that were learned with
that script as candidates. A word's score for a language is the log-likelihood of its
character n-grams and of itself, relative to the best language. Viterbi with a penalty for
switching labels every word, so that a text falls into spans of one language each. The
prediction is the language of most letters; its score is that language's share of all
letters. A text's fit is the share of its letters whose n-gram of three was met in training, in
whatever language; it doesn't depend on how many languages were learned.

A word is a run of letters of one script and the marks on them, so that texts without spaces fall apart where the
script changes. Training counts n-grams over a sample of labelled rows, chosen by a hash of the id: of each language
at most about its share of ``MAX_DOCS`` rows and of ``MAX_CHARS`` characters, so that rare languages are learned too.
All n-grams that occur twice in a language's sample are kept; the sample bounds the model that is collected and broadcast.
Prediction runs in step over a batch's texts: at each position one array operation serves all texts that are so long.

Defined cases: a null text, or one without letters, is ``und`` with score 0; letters of
scripts that were not learned count against the score, and a text with no others gets the
most frequent language with score 0; of languages with equally many letters the first by name is
predicted, and in a path that scores the same the more frequent one; texts and words of any
length are scored whole; without training rows every text is ``und``; repeated rows give repeated
results; an empty table gives an empty result; columns besides those named are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import Counter
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from anamnesis.llm.bpe import char_class
from anamnesis.llm.common import bounded, map_rows, pick, release, settle

#: Labelled rows to train on, and their characters; each language has an equal share.
MAX_DOCS, MAX_CHARS = 6_000, 16_000_000
ORDERS = (1, 2, 3)
SWITCH_PENALTY = 6.0
#: A word's log-likelihood ratio counts up to here.
WORST = -12.0
#: Letters whose n-grams lie in dense tables, and how many values those hold at most; n-grams of all
#: other letters are looked up. Both set speed only.
ALPHABET, DENSE_VALUES = 60, 4_000_000
#: Texts between white space that a worker remembers; then it starts anew.
CHUNKS_REMEMBERED = 150_000
#: Texts that are labelled together.
BLOCK_ROWS = 1000
#: Words are scored in pieces of so many letters, and so many pieces at once.
PIECE, PIECES = 1000, 20_000
UNKNOWN = "und"
#: A language is a candidate for a script that this share of its letters has.
SCRIPT_SHARE = 0.02
LETTER_BITS = 21

# First code points of blocks by script; a block ends where the next begins.
SCRIPT_STARTS = [
    (0x0000, "Latin"), (0x0370, "Greek"), (0x0400, "Cyrillic"), (0x0530, "Armenian"), (0x0590, "Hebrew"),
    (0x0600, "Arabic"), (0x0700, "Other"), (0x0900, "Devanagari"), (0x0980, "Bengali"), (0x0A00, "Other"),
    (0x0B80, "Tamil"), (0x0C00, "Other"), (0x0E00, "Thai"), (0x0E80, "Other"), (0x10A0, "Georgian"),
    (0x1100, "Hangul"), (0x1200, "Other"), (0x1E00, "Latin"), (0x1F00, "Greek"), (0x2000, "Other"),
    (0x3040, "Kana"), (0x3100, "Other"), (0x3400, "Han"), (0xA000, "Other"), (0xAC00, "Hangul"), (0xD7B0, "Other"),
    (0xF900, "Han"), (0xFB00, "Latin"), (0xFB13, "Other"), (0xFF21, "Latin"), (0xFF66, "Kana"), (0xFFA0, "Other"),
    (0x20000, "Han"), (0x32000, "Other"),
]
SCRIPTS = sorted({name for _, name in SCRIPT_STARTS})
_starts = [s for s, _ in SCRIPT_STARTS]
_script_of_block = np.array([SCRIPTS.index(name) for _, name in SCRIPT_STARTS])


def script_of(word: str) -> str:
    """The script of a word's letters."""
    return SCRIPT_STARTS[bisect_right(_starts, ord(word[0])) - 1][1]


def _word_pattern() -> re.Pattern[str]:
    """Letters of one script, and any marks on them."""
    letters = re.compile(f"[{char_class('L')}]+")
    ends = [*_starts[1:], 0x110000]
    own: dict[str, list[str]] = {}
    for (start, name), end in zip(SCRIPT_STARTS, ends):
        block = "".join(map(chr, (i for i in range(start, end) if not 0xD800 <= i < 0xE000)))
        own.setdefault(name, []).extend(f"\\U{ord(m[0][0]):08x}-\\U{ord(m[0][-1]):08x}" for m in letters.finditer(block))
    marks = char_class("M")
    return re.compile("|".join(f"[{''.join(ranges)}][{''.join(ranges)}{marks}]*" for ranges in own.values()))


_words = _word_pattern()
_find_words, _each_word = _words.findall, _words.finditer


def grams(word: str) -> list[str]:
    """A lower-case word's n-grams with its ends marked, and the word itself."""
    marked = f"<{word}>"
    out = [marked[i : i + n] for n in ORDERS for i in range(len(marked) - n + 1)]
    out.append(f"={word}")
    return out


class LanguageModel:
    """Log-probabilities of n-grams and of whole words.

    N-grams of the most frequent letters lie in dense arrays, those with any other learned letter
    in sorted arrays, so each learned letter has a place of its own and the model's size is
    bounded by the numbers of n-grams and languages. Letters that weren't learned share place 2.
    Beside the languages' values stands 1 for n-grams of the longest order that were met, else 0.
    """

    def __init__(self, langs: list[str], scripts: np.ndarray, letters: dict[str, int], tables: list[np.ndarray], rare: list[tuple[np.ndarray, np.ndarray]], words: dict[str, tuple], unseen: tuple):
        """``langs``: the most frequent first; ``scripts``: whether a language (column) is a candidate
        for a script (row, by ``SCRIPTS``); ``letters``: places, the dense ones first; ``tables``: by order;
        ``rare``: by order, sorted codes of n-grams and their values."""
        self.langs, self.scripts, self.tables, self.rare, self.words, self.unseen = langs, scripts, tables, rare, words, unseen
        self.places = np.full(0x110000, 2, np.int32)
        for letter, place in letters.items():
            self.places[ord(letter)] = place
        self.known: dict[str, int] = {}  # first row of scores << 31 | number of words
        self.reset()

    def reset(self) -> None:
        """Forget the chunks met; scores of their words are rows of ``scores``."""
        self.known.clear()
        self.scores = np.zeros((1024, len(self.langs)), np.float32)
        self.weights = np.zeros((1024, 3), np.int64)  # letters, those that count, and those whose n-gram was met
        self.used = 0

    def score(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Relative log-likelihoods of words by language, whether any language has the script, and how
        many n-grams of the longest order were met."""
        text = "<" + "><".join(words) + ">"
        codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
        size = np.fromiter(map(len, words), np.int64, len(words)) + 2
        start = np.cumsum(size) - size
        ends = start + size
        total = np.zeros((len(words), len(self.langs) + 1))
        total[:, :-1] = [self.words.get(w, self.unseen) for w in words]
        pieces = -(-size // PIECE)
        word = np.repeat(np.arange(len(words)), pieces)
        begin = start[word] + PIECE * (np.arange(len(word)) - np.repeat(np.cumsum(pieces) - pieces, pieces))
        for i in range(0, len(word), PIECES):
            mine, owner = begin[i : i + PIECES], word[i : i + PIECES]
            low, high = mine[0], begin[i + PIECES] if i + PIECES < len(word) else len(codes)
            sums = self._sums(codes, low, high, start, ends, mine - low)
            first = np.flatnonzero(np.diff(owner, prepend=-1))
            total[owner[first]] += np.add.reduceat(sums, first, axis=0, dtype=np.float64)
        script = np.searchsorted(_starts, codes[start + 1], side="right") - 1
        candidate = self.scripts[_script_of_block[script]]
        met, total = np.rint(total[:, -1]).astype(np.int64), total[:, :-1]
        total = np.where(candidate, total, -np.inf)
        best = total.max(axis=1, keepdims=True)
        any_ = candidate.any(axis=1)
        relative = np.maximum(WORST, (total - np.where(any_[:, None], best, 0)) / len(ORDERS))
        relative = np.where(candidate, relative, 2 * WORST)
        relative[~any_] = 0
        return relative.astype(np.float32), any_, met

    def _sums(self, codes: np.ndarray, low: int, high: int, start: np.ndarray, ends: np.ndarray, pieces: np.ndarray) -> np.ndarray:
        """Sums over pieces of the log-probabilities of n-grams that begin at ``codes[low:high]``;
        words lie from ``start`` to ``ends``, and ``pieces`` begin so far after ``low``."""
        size, beyond = high - low, min(high + ORDERS[-1] - 1, len(codes))
        letters = self.places[codes[low:beyond]]
        here = slice(np.searchsorted(start, low), np.searchsorted(start, beyond))
        letters[start[here] - low] = 0
        over = ends[np.searchsorted(ends, low, side="right") : np.searchsorted(ends, beyond, side="right")]
        letters[over - 1 - low] = 1
        over = ends[np.searchsorted(ends, low, side="right") : np.searchsorted(ends, high + ORDERS[-1])] - low
        width = len(self.tables[0])
        rare = letters >= width
        dense = np.where(rare, 2, letters) if (any_rare := bool(rare.any())) else letters
        index, code, hit = (np.zeros(size, np.int64) for _ in range(3))
        out = np.zeros((len(pieces), len(self.langs) + 1), np.float32)
        for n, table, (keys, found) in zip(ORDERS, self.tables, self.rare):
            there = max(0, min(size, len(letters) - n + 1))
            index *= width
            index[:there] += dense[n - 1 : n - 1 + there]
            values = table[index]
            if any_rare:
                code <<= LETTER_BITS
                code[:there] += letters[n - 1 : n - 1 + there]
                hit[:there] += rare[n - 1 : n - 1 + there]
                at = np.flatnonzero(hit)
                if len(keys) and len(at):
                    k = np.minimum(np.searchsorted(keys, code[at]), len(keys) - 1)
                    same = keys[k] == code[at]
                    values[at[same]] = found[k[same]]
            for k in range(1, n):  # n-grams that would run over a word's end
                past = over - k
                values[past[(past >= 0) & (past < size)]] = 0
            out += np.add.reduceat(values, pieces, axis=0)
        return out

    def _learn(self, chunks: list[str]) -> None:
        words = [_find_words(c) for c in chunks]
        flat = [w.lower() for mine in words for w in mine]
        if flat:
            found, counted, met = self.score(flat)
            while self.used + len(flat) > len(self.scores):
                self.scores = np.concatenate([self.scores, np.zeros_like(self.scores)])
                self.weights = np.concatenate([self.weights, np.zeros_like(self.weights)])
            here = slice(self.used, self.used + len(flat))
            length = [len(w) for mine in words for w in mine]
            self.scores[here], self.weights[here, 0] = found, length
            self.weights[here, 1] = length * counted
            self.weights[here, 2] = met
        at = self.used
        for chunk, mine in zip(chunks, words):
            self.known[chunk] = at << 31 | len(mine)
            at += len(mine)
        self.used = at

    def label(self, texts: list[str | None]) -> list[tuple[str, float, list[tuple[str, int, int]], float]]:
        """For each text its language, the score, spans (language, start, end) that tile it, and the fit."""
        out: list = [(UNKNOWN, 0.0, [], 0.0)] * len(texts)
        if not self.langs or not texts:
            return out
        pieces = pc.utf8_split_whitespace(pa.array([t or "" for t in texts], pa.large_string()))
        coded = pieces.flatten().dictionary_encode()
        chunks = coded.dictionary.to_pylist()
        if len(self.known) > CHUNKS_REMEMBERED:
            self.reset()
        if unknown := [c for c in chunks if c not in self.known]:
            self._learn(unknown)
        places = np.array([self.known[c] for c in chunks], np.int64)
        begin, count = places >> 31, places & 0x7FFFFFFF
        which = coded.indices.to_numpy()
        sizes = count[which]
        ends = np.cumsum(sizes)
        ids = np.repeat(begin[which] - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)
        borders = np.concatenate([[0], ends])[pieces.offsets.to_numpy()]
        first, lengths = borders[:-1], np.diff(borders)
        if not len(ids):
            return out
        path = viterbi(ids, first, lengths, self.scores)
        for i in np.flatnonzero(lengths):
            here = slice(first[i], first[i] + lengths[i])
            labels, weight = path[here], self.weights[ids[here]]
            letters = np.bincount(labels, weight[:, 1], len(self.langs))
            best = min(range(len(self.langs)), key=lambda k: (-letters[k], self.langs[k]))
            if not letters[best]:
                best = 0
            changes = np.flatnonzero(np.diff(labels)) + 1
            spans = [0]
            if len(changes):
                at = [m.start() for m in _each_word(texts[i])]
                spans += [at[k] for k in changes]
            names = [self.langs[labels[k]] for k in [0, *changes]]
            out[i] = (
                self.langs[best],
                float(letters[best] / weight[:, 0].sum()),
                [*zip(names, spans, [*spans[1:], len(texts[i])])],
                float(weight[:, 2].sum() / weight[:, 0].sum()),
            )
        return out


def viterbi(ids: np.ndarray, first: np.ndarray, lengths: np.ndarray, scores: np.ndarray) -> np.ndarray:
    """The best label of each word: ``ids`` index ``scores``; texts lie one after another."""
    order = np.argsort(-lengths, kind="stable")
    start, size = first[order], lengths[order]
    active = len(size) - np.searchsorted(size[::-1], np.arange(size[0]), side="right")
    states = scores.shape[1]
    value = np.zeros((len(size), states), np.float32)
    switched, source = np.zeros((len(ids), states), bool), np.zeros(len(ids), np.int32)
    for t, n in enumerate(active):
        at = start[:n] + t
        now = value[:n]
        if t:
            top = now.argmax(axis=1)
            jump = (now[np.arange(n), top] - SWITCH_PENALTY)[:, None]
            better = jump > now
            switched[at], source[at] = better, top
            now = np.where(better, jump, now)
            now = now - now.max(axis=1, keepdims=True)  # keeps values small in long texts
        value[:n] = now + scores[ids[at]]
    path = np.zeros(len(ids), np.int32)
    state = value.argmax(axis=1)
    for t in range(len(active) - 1, -1, -1):
        n = active[t]
        at = start[:n] + t
        mine = state[:n]
        path[at] = mine
        state[:n] = np.where(switched[at, mine], source[at], mine)
    return path


def held_out(id_col: str = "doc_id") -> Column:
    """Rows that training leaves out: crc32 of the id's text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> LanguageModel:
    """Learn from the rows of ``docs`` (``doc_id, text, lang``) that aren't held out."""
    settle(docs.sparkSession)
    rows = pick(docs, "doc_id", "text", "lang").where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    sizes = rows.groupBy("lang").agg(F.count("*").alias("n"), F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars")).collect()  # a row per language
    share = {r.lang: min(1.0, max_docs / len(sizes) / r.n, max_chars / len(sizes) / max(r.chars, 1)) for r in sizes}
    below = docs.sparkSession.createDataFrame([(k, int(v * (1 << 30)) + 1) for k, v in share.items()], "lang string, below long")
    sample = rows.join(F.broadcast(below), "lang").where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 30)) < F.col("below"))

    def count(batches):
        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch["lang"], batch["text"]):
                words.setdefault(lang, Counter()).update(_find_words((text or "").lower()))
            for lang, mine in words.items():
                total: Counter = Counter()
                for word, times in mine.items():
                    total[f"script {script_of(word)}"] += times * len(word)
                    for gram in grams(word):
                        total[gram] += times
                for gram, times in total.items():
                    yield lang, gram, times

    counts = map_rows(
        sample.select("text", "lang"),
        "lang string, gram string, n long",
        pa.schema([("lang", pa.string()), ("gram", pa.string()), ("n", pa.int64())]),
        count,
    )
    counts = counts.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return build(counts.where("n >= 2").collect())


def build(found: list[tuple[str, str, int]]) -> LanguageModel:
    """A model from rows (language, n-gram or script, count)."""
    letters: dict[str, Counter] = {}
    by_gram: dict[str, dict[str, int]] = {}
    for lang, gram, n in found:
        if gram.startswith("script "):
            letters.setdefault(lang, Counter())[gram[7:]] += n
        else:
            by_gram.setdefault(gram, {})[lang] = n
    langs = sorted(letters, key=lambda k: (-letters[k].total(), k))
    scripts = np.zeros((len(SCRIPTS), max(1, len(langs))), bool)
    for k, lang in enumerate(langs):
        for script, n in letters[lang].items():
            scripts[SCRIPTS.index(script), k] = n >= SCRIPT_SHARE * letters[lang].total()
    single = Counter()
    for gram, mine in by_gram.items():
        if gram[0] != "=":
            for letter in {*gram} - {"<", ">"}:
                single[letter] += sum(mine.values()) if gram == letter else 0
    places = {"<": 0, ">": 1} | {g: 3 + i for i, (g, _) in enumerate(sorted(single.items(), key=lambda x: (-x[1], x[0])))}
    width = 3 + min(ALPHABET, max(0, int((DENSE_VALUES / (len(langs) + 1)) ** (1 / ORDERS[-1])) - 3))
    tables, rare = [], []
    for n in ORDERS:
        mine = {gram: [by_gram[gram].get(lang, 0) for lang in langs] for gram in by_gram if len(gram) == n and gram[0] != "="}
        sums = np.array([*mine.values()], np.float64).reshape(len(mine), len(langs)).sum(axis=0) + 0.5 * (len(mine) + 1)
        table, others = np.zeros((width**n, len(langs))), []
        for gram, counts in mine.items():
            at = [places[letter] for letter in gram]
            if max(at) < width:
                table[sum(p * width ** (n - 1 - i) for i, p in enumerate(at))] = counts
            else:
                others.append((sum(p << LETTER_BITS * (n - 1 - i) for i, p in enumerate(at)), counts))
        others.sort()
        values = np.array([counts for _, counts in others], np.float64).reshape(len(others), len(langs))
        shown = lambda x: np.column_stack([np.log((x + 0.5) / sums), (n == ORDERS[-1]) & (x.sum(axis=1) > 0)]).astype(np.float32)  # noqa: E731, B023
        tables.append(shown(table))
        rare.append((np.array([code for code, _ in others], np.int64), shown(values)))
    whole = {g[1:]: mine for g, mine in by_gram.items() if g[0] == "=" and len(g) > 1}
    totals = [sum(mine.get(lang, 0) for mine in whole.values()) + 0.5 * len(whole) + 1 for lang in langs]
    words = {
        w: tuple(log((mine.get(lang, 0) + 0.5) / totals[k]) for k, lang in enumerate(langs)) for w, mine in whole.items()
    }
    return LanguageModel(langs, scripts[:, : len(langs)], places, tables, rare, words, tuple(log(0.5 / t) for t in totals))


def identify(docs: DataFrame, model: LanguageModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: the id, ``lang_pred``, ``score``, ``fit`` and ``spans``, an array of
    (lang, start, end) that tile the text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rows(batches):
        for batch in batches:
            for i in range(0, len(batch["id"]), BLOCK_ROWS):  # bounds what labelling holds at once
                texts = batch["text"][i : i + BLOCK_ROWS]
                for key, (lang, score, spans, fit) in zip(batch["id"][i : i + BLOCK_ROWS], shared.value.label(texts)):
                    yield key, lang, score, fit, [{"lang": a, "start": b, "end": c} for a, b, c in spans]

    one = pa.struct([("lang", pa.string()), ("start", pa.int64()), ("end", pa.int64())])
    return map_rows(
        pick(docs, id_col, text_col).toDF("id", "text").withColumn("id", F.col("id").cast("long")),
        f"{id_col} long, lang_pred string, score double, fit double, spans array<struct<lang: string, start: long, end: long>>",
        pa.schema([(id_col, pa.int64()), ("lang_pred", pa.string()), ("score", pa.float64()), ("fit", pa.float64()), ("spans", pa.list_(one))]),
        rows,
        lambda row: 88 + 48 * len(row[4]),
        lambda: shared.value.reset(),
    )


def keep_identified(docs: DataFrame, model: LanguageModel, least: float, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with letters whose fit is at least ``least``, with all columns as they are.
    Whole batches are filtered, so nothing is shuffled."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)
    places = docs.toDF(*(f"_c{i}" for i in range(len(docs.columns))))

    def run(batches):
        for batch in batches:
            for i in range(0, batch.num_rows, BLOCK_ROWS):
                part = batch.slice(i, BLOCK_ROWS)
                found = shared.value.label(part.column(at).to_pylist())
                yield part.filter(pa.array([lang != UNKNOWN and fit >= least for lang, _, _, fit in found], pa.bool_()))
        shared.value.reset()
        release()

    bounded(docs.sparkSession)
    return places.mapInArrow(run, places.schema).toDF(*docs.columns)
