"""Toxicity by fuzzy lexicon matching.

The lexicon is learned from labelled rows: words, and stems that begin many words, which mark toxic documents.  It is held in a
trie.  A word is matched by walking the trie with the Levenshtein automaton of the word: a branch dies as soon as no state of the
automaton is within the edits a term allows, so misspelled terms are found without comparing term by term.  Only distinct words
whose length and letters leave some term in reach are walked.  A hit counts less the more it is misspelled, and less inside
quotation marks or after words of reporting; a document's score joins its hits as independent evidence.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from wordloom.llm.labels import sample
from wordloom.llm.simhash import distinct_texts
from wordloom.llm.text import Words, mix64, prefix, slices, span

#: bound of the training sample, rows of label 0 and of label 1
PER_CLASS = (6000, 3000)
#: lengths of stems in bytes, and the words one must begin; documents a term must explain; the share of toxic ones among documents with a term;
#: the chance that any term at all passes without meaning anything
STEMS = range(4, 11)
MIN_VARIETY = 8
MIN_DOCS = 3
PRECISION = 0.8
CHANCE = 0.01
#: share of clean documents that may hold a word within a term's edits, else the term allows fewer; or a term that isn't needed, else it is left out
ASTRAY = 1 / 5000
WEIGHT = {0: 1.0, 1: 0.8, 2: 0.6}
QUOTED = 0.25
REPORTED = 0.5
#: words before a hit, in its sentence, that may report it
CUE_WORDS = 4
TOXIC = 0.5
CUES = frozenset("said says say called calls call quote quoted quotes wrote writes word words term insult insults sagte sagt nannte nennt zitiert wort dit disait appelle traite cite mot dijo dice llama llamó cita palabra".encode().split())
MARKS = {"“": "”", "„": "“", "«": "»", "‹": "›", "‘": "’"}

DDL = "doc_id bigint, toxicity double, n_hits int, n_misspelled int, n_quoted int, terms array<string>, toxic boolean"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("toxicity", pa.float64()), ("n_hits", pa.int32()), ("n_misspelled", pa.int32()), ("n_quoted", pa.int32()), ("terms", pa.list_(pa.string())), ("toxic", pa.bool_())])


def edits(term: str) -> int:
    """Edits within which a word is taken for a misspelled term."""
    return 0 if len(term) < 5 else 1 if len(term) < 9 else 2


class Automaton:
    """The Levenshtein automaton of a word: a state is the edits needed to reach each place of the word, beyond most as one."""

    def __init__(self, word: str, most: int):
        self.word, self.most = word, most
        self.start = tuple(min(i, most + 1) for i in range(len(word) + 1))
        self._next: dict = {}

    def step(self, state: tuple, letter: str) -> tuple:
        found = self._next.get((state, letter))
        if found is None:
            row = [min(state[0] + 1, self.most + 1)]
            for i, c in enumerate(self.word):
                row.append(min(state[i] + (c != letter), state[i + 1] + 1, row[i] + 1, self.most + 1))
            found = self._next[state, letter] = tuple(row)
        return found


class Trie:
    """Terms with the edits that each allows."""

    def __init__(self, terms: dict[str, int]):
        self.root: dict = {}
        self.most = max(terms.values(), default=0)
        for term, room in terms.items():
            node = self.root
            for c in term:
                node = node.setdefault(c, {})
            node[None] = (term, room)

    def near(self, word: str) -> list[tuple[int, str]]:
        """(distance, term) of each term within the edits that it allows, nearest first."""
        most = self.most
        automaton = Automaton(word, most)
        out, todo = [], [(self.root, automaton.start)]
        while todo:
            node, state = todo.pop()
            for c, child in node.items():
                if c is None:
                    if state[-1] <= child[1]:
                        out.append((state[-1], child[0]))
                elif min(after := automaton.step(state, c)) <= most:
                    todo.append((child, after))
        return sorted(out)


@dataclass
class Lexicon:
    """terms: the edits each allows; stems: beginnings of words, taken exactly."""

    terms: dict[str, int]
    stems: tuple[str, ...]

    def __post_init__(self):
        self.trie = Trie(self.terms)
        self.seen: dict[bytes, tuple[int, str] | None] = {}
        fuzzy = [t.encode() for t, room in self.terms.items() if room]
        self.mask = np.array([_letters(np.frombuffer(t, np.uint8), np.zeros(1, np.int64))[0] for t in fuzzy], np.uint64)
        self.size = np.array([len(t) for t in fuzzy], np.int64)
        self.room = np.array([self.terms[t.decode()] for t in fuzzy], np.int64)
        self.exact = _hashes(self.terms)
        self.by_size: dict[int, list[str]] = defaultdict(list)
        for s in self.stems:
            self.by_size[len(s.encode())].append(s)

    def hits(self, words: Words) -> list[tuple[int, int, str]]:
        """(word, distance, term) of the words that match a term or begin with a stem."""
        if not len(words.s) or not (self.terms or self.stems):
            return []
        sums = prefix(words.folded.astype(np.uint64) + np.uint64(1))
        _, example, which = np.unique(words.h, return_index=True, return_inverse=True)
        s, e = words.s[example], words.e[example]
        size = e - s
        hit = np.isin(words.h[example], self.exact)
        for n, stems in self.by_size.items():
            long = np.flatnonzero(size >= n)
            hit[long] |= np.isin(span(sums, s[long], s[long] + n), _hashes(stems))
        if len(self.mask):
            # an edit changes the length by one character, of four bytes at most, and the set of letters by two at most
            letters = _letters_of(words, s, e)
            for mask, n, room in zip(self.mask, self.size, self.room, strict=True):
                hit |= (np.abs(size - n) <= 4 * room) & (np.bitwise_count(letters ^ mask) <= 2 * room)
        found: dict[int, tuple[int, str]] = {}
        for i in np.flatnonzero(hit):
            raw = words.folded[s[i] : e[i]].tobytes()
            if raw not in self.seen:
                if len(self.seen) > 1 << 18:
                    self.seen.clear()
                self.seen[raw] = self.match(raw.decode())
            if self.seen[raw]:
                found[i] = self.seen[raw]
        at = np.flatnonzero(np.isin(which, np.fromiter(found, np.int64, len(found))))
        return [(int(w), *found[int(which[w])]) for w in at]

    def match(self, word: str) -> tuple[int, str] | None:
        near = self.trie.near(word)
        stem = next((t for t in self.stems if word.startswith(t)), None)
        return near[0] if near and (near[0][0] == 0 or not stem) else (0, stem) if stem else None


def _hashes(terms: Iterable[str]) -> np.ndarray:
    return Words(pa.array(list(terms), pa.string())).h


_MASK = np.array([1 << (b % 64 if b < 128 else 63) for b in range(256)], np.uint64)  # all bytes beyond ASCII are one letter


def _letters(raw: np.ndarray, start: np.ndarray) -> np.ndarray:
    return np.bitwise_or.reduceat(_MASK[raw], start)


def _letters_of(words: Words, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """For each word [s, e) the set of its bytes as bits."""
    size = e - s
    first = np.cumsum(size) - size
    flat = words.folded[np.arange(int(size.sum())) + np.repeat(s - first, size)]
    return _letters(flat, first)


class Context:
    """Where lines, sentences and quotations of a text begin and end, in bytes; found once for all its hits."""

    def __init__(self, text: bytes):
        raw = np.frombuffer(text, np.uint8)
        self.lines = [-1, *np.flatnonzero(raw == 10).tolist(), len(text)]
        self.ends = np.flatnonzero(np.isin(raw, np.frombuffer(b".!?\n", np.uint8))).tolist()
        self.straight = np.flatnonzero(raw == 34).tolist()
        places = {m: [x.start() for x in re.finditer(m.encode(), text)] for m in {*MARKS, *MARKS.values()}} if (raw >= 128).any() else {}
        self.pairs = [(places[a], places[b]) for a, b in MARKS.items() if places.get(a) and places.get(b)]

    def sentence(self, at: int) -> int:
        """Where the sentence of a place begins."""
        k = bisect_left(self.ends, at)
        return self.ends[k - 1] + 1 if k else 0

    def quoted(self, start: int, end: int) -> bool:
        """Whether a place is inside quotation marks that open and close in its line."""
        k = bisect_left(self.lines, start)
        lo, hi = self.lines[k - 1] + 1, self.lines[bisect_left(self.lines, end)]
        before = bisect_left(self.straight, start)
        if (before - bisect_left(self.straight, lo)) % 2 and _some(self.straight, end, hi):
            return True
        return any(max(lo - 1, _last(a, start)) > max(lo - 1, _last(b, start)) and _some(b, end, hi) for a, b in self.pairs)


def _last(places: list[int], before: int) -> int:
    k = bisect_left(places, before)
    return places[k - 1] if k else -1


def _some(places: list[int], start: int, end: int) -> bool:
    k = bisect_left(places, start)
    return k < len(places) and places[k] < end


def learn(texts: list[str], y: np.ndarray, share: float) -> Lexicon:
    """Terms and stems that mark toxic documents, share being how many of all documents are toxic.

    A candidate must be precise at that share and beyond chance, by Chernoff's bound corrected for the number of candidates.  Then
    greedily: the one that explains most toxic documents not yet explained, less the clean ones that hold it, each at its share of all
    documents; a word before a stem, a long stem before a short one, until none explains MIN_DOCS.  Candidates that the choice had no need
    of are added if no more than ASTRAY of the clean documents hold them, unless a stem covers them.  A term allows as many edits as its
    length does, but fewer where clean documents hold such words.  Near copies count once: the words of one document that was copied are
    no evidence.
    """
    kept = distinct_texts(texts)
    texts, y = [texts[i] for i in kept], y[kept]
    n_toxic, n_clean = max(1, int(y.sum())), max(1, int(len(y) - y.sum()))
    toxic, clean = [texts[i] for i in np.flatnonzero(y == 1)], [texts[i] for i in np.flatnonzero(y == 0)]
    empty = np.zeros(0, np.uint64), np.zeros(0, np.int32)
    name, doc = (np.concatenate(x) for x in zip(*[empty, *((h, d) for h, d, _, _ in _names(toxic))], strict=True))
    names, count = np.unique(name, return_counts=True)
    limit = math.log(CHANCE / max(1, len(names)))
    names, count = names[count >= MIN_DOCS], count[count >= MIN_DOCS]
    other = np.zeros(len(names), np.int64)
    for h, _, _, _ in _names(clean):
        h, c = np.unique(h[np.isin(h, names)], return_counts=True)
        other[np.searchsorted(names, h)] += c

    def good(k: int, c: int) -> bool:
        bad, fine = share * k / n_toxic, (1 - share) * c / n_clean
        p, r = k / (k + c), n_toxic / (n_toxic + n_clean)
        if bad < PRECISION * (bad + fine) or p <= r:
            return False
        return -(k + c) * (p * math.log(p / r) + ((1 - p) * math.log((1 - p) / (1 - r)) if c else 0)) <= limit

    precise = np.array([good(k, c) for k, c in zip(count.tolist(), other.tolist(), strict=True)], bool)
    names, strays = names[precise], dict(zip(names[precise].tolist(), other[precise].tolist(), strict=True))
    spelled: dict[int, tuple[bool, str]] = {}
    variety: dict[int, set[int]] = defaultdict(set)
    for h, _, word, text in _names(toxic):
        for i in np.flatnonzero(np.isin(h, names)):
            spelled[int(h[i])] = text(i)
            variety[int(h[i])].add(int(word[i]))
    mine = np.isin(name, names)
    where: dict[tuple[bool, str], set[int]] = defaultdict(set)
    astray: dict[tuple[bool, str], int] = {}
    for h, d in zip(name[mine].tolist(), doc[mine].tolist(), strict=True):
        stem, text = spelled[h]
        if not text.isdigit() and (not stem or len(variety[h]) >= MIN_VARIETY):
            where[stem, text].add(d)
            astray[stem, text] = strays[h]
    chosen = sorted(where)

    def net(k: tuple[bool, str]) -> float:
        return share * len(where[k] & left) / n_toxic - (1 - share) * astray[k] / n_clean

    terms, stems = [], []
    left, order = set().union(*where.values()), chosen
    while order := [k for k in order if len(where[k] & left) >= MIN_DOCS and net(k) > 0]:
        best = max(order, key=lambda k: (net(k), not k[0], len(k[1])))
        (stems if best[0] else terms).append(best[1])
        left -= where[best]
    chosen = [k for k in chosen if astray[k] <= n_clean * ASTRAY]
    for _, stem in sorted((k for k in chosen if k[0]), key=lambda k: (-len(where[k]), -len(k[1]), k[1])):
        if not any(stem.startswith(x) or x.startswith(stem) for x in stems):
            stems.append(stem)
    terms += [k[1] for k in chosen if not k[0] and k[1] not in terms and not k[1].startswith(tuple(stems))]
    return Lexicon(_rooms(terms, clean), tuple(sorted(stems)))


def _names(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, Callable]]:
    """For slices of texts: each distinct (name, text) as hash and number, a word's hash with that name, and a function that spells it.

    A name is a word, or the first bytes of a longer word, as many as STEMS says, up to a whole character.
    """
    done = 0
    for part in slices(iter([pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], names=["text"])]), "text"):
        words = Words(part.column("text"))
        sums = prefix(words.folded.astype(np.uint64) + np.uint64(1))
        row = words.row
        at, end = [np.arange(len(words.s))], []
        end.append(words.e[at[0]])
        for n in STEMS:
            long = np.flatnonzero(words.e - words.s > n)
            long = long[(words.raw[words.s[long] + n] & 0xC0) != 0x80]
            at.append(long)
            end.append(words.s[long] + n)
        stem = np.repeat(np.arange(len(at)) > 0, [len(x) for x in at])
        at, end = np.concatenate(at), np.concatenate(end)
        h = mix64(span(sums, words.s[at], end) + stem.astype(np.uint64))
        key = mix64(h + mix64(row[at].astype(np.uint64)))
        keep = np.unique(key, return_index=True)[1]

        def text(i: int, words=words, at=at[keep], end=end[keep], stem=stem[keep]) -> tuple[bool, str]:
            return bool(stem[i]), words.folded[words.s[at[i]] : end[i]].tobytes().decode()

        # a text's other words with the same stem are lost here; texts are many, so the variety of a stem shows all the same
        yield h[keep], (done + row[at[keep]]).astype(np.int32), words.h[at[keep]], text
        done += part.num_rows


def _rooms(terms: list[str], clean: list[str]) -> dict[str, int]:
    rooms = {t: edits(t) for t in sorted(terms)}
    known = Lexicon(rooms, ())
    astray: dict[tuple[str, int], set[int]] = defaultdict(set)
    done = 0
    for part in slices(iter([pa.RecordBatch.from_arrays([pa.array(clean, pa.string())], names=["text"])]), "text"):
        words = Words(part.column("text"))
        row = words.row
        for w, distance, term in known.hits(words):
            for d in range(max(1, distance), 3) if distance else ():
                astray[term, d].add(done + int(row[w]))
        done += part.num_rows
    return {t: next((d for d in range(room, 0, -1) if len(astray[t, d]) <= len(clean) * ASTRAY), 0) for t, room in rooms.items()}


def fit(docs: DataFrame, labels: DataFrame, per_class: int | tuple[int, int] = PER_CLASS) -> Lexicon:
    return learn(*sample(docs, labels, "toxic", per_class))


def assess(words: Words, lexicon: Lexicon) -> Iterator[tuple[int, float, int, int, int, list[str]]]:
    """(row, score, hits, misspelled, quoted, terms) of each row with a hit."""
    by_row: dict[int, list] = defaultdict(list)
    row = words.row
    for hit in lexicon.hits(words):
        by_row[int(row[hit[0]])].append(hit)
    for r, hits in by_row.items():
        lo, hi = int(words.off[r]), int(words.off[r + 1])
        context = Context(words.raw[lo:hi].tobytes())
        clear, wrong, cited, terms = 1.0, 0, 0, set()
        for w, distance, term in hits:
            s, e = int(words.s[w]) - lo, int(words.e[w]) - lo
            weight = WEIGHT[distance]
            sentence = context.sentence(s) + lo
            if context.quoted(s, e):
                weight *= QUOTED
                cited += 1
            elif any(words.s[v] >= sentence and words.folded[words.s[v] : words.e[v]].tobytes() in CUES for v in range(max(int(words.first[r]), w - CUE_WORDS), w)):
                weight *= REPORTED * 0.9
                cited += 1
            clear *= 1 - min(weight, 0.999)
            wrong += distance > 0
            terms.add(term)
        yield r, 1 - clear, len(hits), wrong, cited, sorted(terms)


def detect(docs: DataFrame, lexicon: Lexicon, threshold: float = TOXIC) -> DataFrame:
    """One row for each document of docs(doc_id, text) that scores at least threshold.

    Whole texts are read, however long, and quotations looked for in whole lines.  Of terms equally near a word the first by letters counts.  Null, empty and clean texts give no row; repeated rows give a row each; a null doc_id is kept; an
    empty table, or an empty lexicon, gives no rows.  Other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast((lexicon.terms, lexicon.stems))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Lexicon(*shared.value)
        for part in slices(iter(batches), "text"):
            ids = part.column("doc_id")
            rows = [(ids[r].as_py(), score, hits, wrong, cited, terms, True) for r, score, hits, wrong, cited, terms in assess(Words(part.column("text")), known) if score >= threshold]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    return docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), docs["text"].alias("text")).mapInArrow(run, DDL)


def op7_toxicity_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxic ones of all documents; nulls, empty and long texts, ties, repeats, empty tables and other columns as detect() says."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return detect(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
