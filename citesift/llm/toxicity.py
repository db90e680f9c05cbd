"""Toxicity scores: Levenshtein automata intersected with a lexicon trie, weighed by their context.

A lexicon of words and stems is learned from labelled documents.  Its trie, intersected with Levenshtein
automata, is one deterministic automaton, built as far as the words need it, that reads the characters of a word and
ends with the nearest lexicon term and its distance.  All words of a block of texts take their steps together, one array operation
per character position, and leave as soon as no term can be reached.

Every hit falls into a cell (term, distance), and its context decides how: a hit between quotation marks within
a window of words counts as a quotation, otherwise as abuse.  A cell's weight is the log likelihood ratio of
documents that hold it; a text's score is the logistic sum of its cells' weights.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from citesift.llm import words as W
from citesift.llm.shared import Tables
from citesift.session import ship_package

FIT_ROWS = 20_000
TERMS = 200
STEM = (4, 12)
# a head must be rarer by chance than one in e**14, since about a million heads are tried
EVIDENCE = 14.0
# and this much of it must come from texts that no other head explains
UNEXPLAINED = 9.0
# a cell with a smaller log likelihood ratio says nothing by itself, and many such cells must not add up
TELLING = 2.0
WINDOW = 8
# automaton states a worker keeps
STATES = 50_000
# bytes of text whose heads are counted at once: a text has about nine heads a word
HEAD_BYTES = 128 << 10

# characters that end a word besides white space, and quotation marks with the side they stand on
_BREAKS = " \t\n\x0b\x0c\r.,;:!?()[]{}/<>…\"“”„«»‹›"
_OPENS, _CLOSES, _EITHER = "“„«‹", "”»›", "\""


def _word_codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Code points of the lower-case texts, each with a newline after it; begin and end of each word; the texts' bounds."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("\n".join([*low, ""]).encode("utf-32-le"), dtype=np.uint32)
    stops = np.cumsum([0, *[len(t) + 1 for t in low]])
    kind = _KIND[np.minimum(codes, len(_KIND) - 1)]
    ink = kind == _LETTER
    # one sign between two letters or digits stays in the word ("st*pid"); signs around a word do not
    ink[1:-1] |= (kind[1:-1] == _SIGN) & ink[:-2] & ink[2:]
    edge = np.diff(ink.astype(np.int8), prepend=np.int8(0))
    begin = np.flatnonzero(edge == 1)
    end = np.flatnonzero(edge == -1)
    return codes, begin, end, stops


_BREAK, _SIGN, _LETTER = 0, 1, 2
_KIND = np.asarray([_LETTER if chr(c).isalnum() else _SIGN for c in range(1 << 16)] + [_SIGN], dtype=np.int8)
_KIND[[ord(c) for c in _BREAKS]] = _BREAK


class Lexicon:
    """Terms, whether each is a stem that may go on, the edits each allows, and the automaton over them.

    The automaton is the intersection of the terms' trie with their Levenshtein automata, made deterministic.  Its
    states come into being when a word first needs them, so what it holds follows the words read, not the number of
    terms; a worker forgets them all once there are more than ``STATES``.  Only the terms travel to the tasks.
    """

    def __init__(self, terms: list[str], stems: list[bool], limits: list[int]):
        self.terms, self.stems, self.limits = terms, stems, limits
        self._children: list[dict[str, int]] = [{}]
        self._ends: list[list[int]] = [[]]
        self._reach = [0]
        for t, term in enumerate(terms):
            node = 0
            self._reach[0] = max(self._reach[0], limits[t])
            for c in term:
                if c not in self._children[node]:
                    self._children[node][c] = len(self._children)
                    self._children.append({})
                    self._ends.append([])
                    self._reach.append(0)
                node = self._children[node][c]
                self._reach[node] = max(self._reach[node], limits[t])
            self._ends[node].append(t)
        self._letters = sorted({c for term in terms for c in term})
        self.class_of = np.zeros(max([0, *map(ord, self._letters)]) + 2, dtype=np.int32)
        for i, c in enumerate(self._letters, 1):
            self.class_of[ord(c)] = i
        self._forget()

    def __reduce__(self):
        return Lexicon, (self.terms, self.stems, self.limits)

    def _forget(self) -> None:
        self._number: dict = {}
        self._states: list = []
        self.table = np.full((64, len(self._letters) + 1), -1, dtype=np.int32)
        self.out_term = np.full(64, -1, dtype=np.int32)
        self.out_edits = np.zeros(64, dtype=np.int32)
        self._state(((), None))
        self.table[0] = 0
        self._start = self._state(self._close({0: 0}, {}))

    def _close(self, items: dict, done: dict) -> tuple:
        """Skip lexicon letters, note finished stems, and drop what cannot improve on them."""
        todo = list(items.items())
        while todo:
            node, e = todo.pop()
            if items.get(node, 99) < e:
                continue
            for t in self._ends[node]:
                if self.stems[t] and e <= self.limits[t] and e < done.get(t, 99):
                    done[t] = e
            for child in self._children[node].values():
                if e + 1 <= self._reach[child] and e + 1 < items.get(child, 99):
                    items[child] = e + 1
                    todo.append((child, e + 1))
        best = min(done.values(), default=99)
        live = {n: e for n, e in items.items() if e < best}
        kept = min(((e, t) for t, e in done.items()), default=None)
        return tuple(sorted(live.items())), kept

    def _state(self, state: tuple) -> int:
        """The number of a state; a new one gets the next."""
        k = self._number.get(state)
        if k is None:
            k = self._number[state] = len(self._states)
            self._states.append(state)
            if k == len(self.table):
                more = len(self.table)
                self.table = np.concatenate([self.table, np.full((more, self.table.shape[1]), -1, np.int32)])
                self.out_term = np.concatenate([self.out_term, np.full(more, -1, np.int32)])
                self.out_edits = np.concatenate([self.out_edits, np.zeros(more, np.int32)])
            items, done = state
            found = [(e, t) for node, e in items for t in self._ends[node] if e <= self.limits[t]]
            best = min([*found, *([done] if done else [])], default=None)
            if best is not None:
                self.out_edits[k], self.out_term[k] = best
        return k

    def _step(self, state: int, letter: int) -> None:
        items, done = self._states[state]
        c = self._letters[letter - 1] if letter else None
        after: dict[int, int] = {}
        for node, e in items:
            steps = [(child, e if x == c else e + 1) for x, child in self._children[node].items()]
            for nxt, f in [(node, e + 1), *steps]:
                if f <= self._reach[nxt] and f < after.get(nxt, 99):
                    after[nxt] = f
        nxt = self._state(self._close(after, {} if done is None else {done[1]: done[0]}))
        self.table[state, letter] = nxt

    def hits(self, codes: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Numbers of the words that are near a term, the term and the distance."""
        if len(self._states) > STATES:
            self._forget()
        cls = self.class_of[np.minimum(codes, len(self.class_of) - 1)]
        word = np.arange(len(begin))
        at, stop = begin.copy(), end
        state = np.full(len(begin), self._start, dtype=np.int32)
        final_word, final_state = [], []
        while len(word):
            after = self.table[state, cls[at]]
            new = np.flatnonzero(after < 0)
            if len(new):
                wide = self.table.shape[1]
                for x in np.unique(state[new].astype(np.int64) * wide + cls[at[new]]).tolist():
                    self._step(x // wide, x % wide)
                after = self.table[state, cls[at]]
            state = after
            at = at + 1
            over = at >= stop
            dead = state == 0
            full = over & ~dead
            if full.any():
                final_word.append(word[full])
                final_state.append(state[full])
            go = ~(over | dead)
            word, at, stop, state = word[go], at[go], stop[go], state[go]
        if not final_word:
            z = np.zeros(0, np.int64)
            return z, z, z
        w, s = np.concatenate(final_word), np.concatenate(final_state)
        good = self.out_term[s] >= 0
        w, s = w[good], s[good]
        order = np.argsort(w, kind="stable")
        return w[order], self.out_term[s[order]], self.out_edits[s[order]]


def _quoted(codes: np.ndarray, text: tuple[int, int], begin: np.ndarray, end: np.ndarray, w: int) -> bool:
    """Does word ``w`` stand between quotation marks within a window of words of its text?"""
    left = codes[max(text[0], begin[max(0, w - WINDOW)] - 1):begin[w]]
    right = codes[end[w]:min(text[1], end[min(len(end) - 1, w + WINDOW)] + 1)]
    a, b = "".join(map(chr, left)), "".join(map(chr, right))
    opened = max(a.rfind(c) for c in _OPENS) > max(a.rfind(c) for c in _CLOSES)
    closes = [i for i in (b.find(c) for c in _CLOSES) if i >= 0]
    opens = [i for i in (b.find(c) for c in _OPENS) if i >= 0]
    closed = bool(closes) and min(closes) < min(opens, default=len(b))
    return (opened and closed) or (a.count(_EITHER) % 2 == 1 and _EITHER in b)


def cells(lexicon: Lexicon, texts: list[str]) -> list[set[tuple[int, int, bool]]]:
    """The cells (term, distance, quoted) that each text holds."""
    out: list[set] = [set() for _ in texts]
    if not lexicon.terms:
        return out
    codes, begin, end, stops = _word_codes(texts)
    w, term, edits = lexicon.hits(codes, begin, end)
    doc = np.searchsorted(stops, begin[w], side="right") - 1
    marks = [any(c in t for c in _OPENS + _EITHER) for t in texts]
    for i, d, t, e in zip(w.tolist(), doc.tolist(), term.tolist(), edits.tolist()):
        quoted = marks[d] and _quoted(codes, (int(stops[d]), int(stops[d + 1])), begin, end, i)
        out[d].add((t, e, quoted))
    return out


@dataclass
class Model:
    lexicon: Lexicon
    weights: dict[tuple[int, int, bool], float]
    prior: float
    without: float

    def score(self, texts: list[str]) -> list[float]:
        """Between 0 and 1; a text without any hit, the empty text among them, gets the share of toxic ones among such."""
        out = []
        for found in cells(self.lexicon, texts):
            weights = [w for w in (self.weights[c] for c in found) if w >= TELLING]
            # cells overlap, so what stands beside the strongest adds only a part
            x = self.prior + 0.7 * max(weights) + 0.3 * sum(weights) if weights else self.without
            out.append(1.0 / (1.0 + math.exp(-max(-30.0, min(30.0, x)))))
        return out


def _heads(seen: set[str]) -> set[str]:
    """What may become a term: the heads of longer words, and whole words that are shorter than a head."""
    return {w[:k] for w in seen for k in range(min(STEM[0], len(w)), min(STEM[1], len(w)) + 1)}


def _texts(batch: pa.RecordBatch, column: str, limit: int = W.BLOCK_BYTES) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    for part, raw, offs in W.blocks(batch, column, limit):
        data, cuts = raw.tobytes(), offs.tolist()
        yield part, [data[a:b].decode("utf-8") for a, b in zip(cuts, cuts[1:])]


def _prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, texts in _texts(batch, "text", HEAD_BYTES):
            low, high = Counter(), Counter()
            whole = Counter()
            for text, toxic in zip(texts, part.column("toxic").to_pylist()):
                codes, begin, end, _ = _word_codes([text])
                line = codes.tobytes().decode("utf-32-le")
                seen = {line[a:b] for a, b in zip(begin.tolist(), end.tolist())}
                (high if toxic else low).update(_heads(seen))
                if toxic:
                    whole.update(w for w in seen if len(w) <= STEM[1])
            heads = sorted({*low, *high})
            yield pa.RecordBatch.from_arrays(
                [pa.array(heads, pa.string())] + [pa.array([c[h] for h in heads], pa.int64()) for c in (high, low, whole)],
                names=["head", "toxic", "clean", "whole"])


def _holders(heads: dict[str, int]):
    """For every toxic text the numbers of the heads it holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, texts in _texts(batch, "text"):
                out = []
                for text in texts:
                    codes, begin, end, _ = _word_codes([text])
                    line = codes.tobytes().decode("utf-32-le")
                    seen = {line[a:b] for a, b in zip(begin.tolist(), end.tolist())}
                    out.append(sorted({heads.get(h, -1) for h in _heads(seen)} - {-1}))
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int32()))], names=["heads"])

    return run


def _lexicon(counts: list, holders: list[list[int]], n_toxic: int, n_clean: int, terms: int) -> Lexicon:
    """Heads taken one by one, each for the toxic texts that no head before it explains.

    Whatever merely stands beside a term, in copies of one text for instance, explains nothing by itself.  Of
    equally good heads the longest is taken.
    """
    where: list[list[int]] = [[] for _ in counts]
    for d, found in enumerate(holders):
        for h in found:
            where[h].append(d)
    left = np.array([len(w) for w in where], dtype=np.float64)
    clean = np.array([r.clean for r in counts], dtype=np.float64)
    length = np.array([len(r.head) for r in counts])
    share = n_toxic / (n_toxic + n_clean)
    open_texts = np.ones(len(holders), bool)
    chosen = []
    while len(counts) and len(chosen) < terms:
        both = left + clean
        with np.errstate(divide="ignore", invalid="ignore"):
            evidence = np.where(left > 0, left * np.log(left / (both * share)), 0.0)
            evidence += np.where(clean > 0, clean * np.log(clean / (both * max(1 - share, 1e-9))), 0.0)
        evidence[left < 3 * clean] = 0.0
        best = int(np.lexsort((length, np.round(evidence, 6)))[-1])
        if evidence[best] < UNEXPLAINED:
            break
        chosen.append(best)
        for d in where[best]:
            if open_texts[d]:
                open_texts[d] = False
                left[holders[d]] -= 1
    # a head that the chosen ones explain is a term of its own if it keeps very different company: it stands in
    # texts with many different sets of chosen heads, while a copied text brings one set however often it comes
    picked = set(chosen)
    company = [frozenset(picked.intersection(h)) for h in holders]
    for i in np.lexsort((-length, -np.array([r.toxic for r in counts])))[:len(counts) if chosen else 0].tolist():
        sets = len({company[d] - {i} for d in where[i]})
        # a word shorter than a head is no part of a longer one
        names = [counts[j].head for j in chosen if min(length[i], length[j]) >= STEM[0]]
        if i not in picked and len(chosen) < terms and sets * -math.log(share) >= EVIDENCE and sets > 3 * clean[i] and not any(
                n.startswith(counts[i].head) or counts[i].head.startswith(n) for n in names):
            chosen.append(i)
    rows = [counts[i] for i in chosen]
    names = [r.head for r in rows]
    return Lexicon(names, [r.whole < 0.9 * r.toxic for r in rows], [0 if len(n) < STEM[0] else 1 if len(n) < 9 else 2 for n in names])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, terms: int = TERMS) -> Model:
    """Learn from at most about ``rows`` labelled documents whose ``crc32(doc_id as text) mod 3`` is not 1.

    ``rows`` bounds the documents read for learning and ``terms`` the lexicon; where more rows are labelled a
    hash of the key chooses.  Rows with a null key or label teach nothing; a document labelled several times
    is toxic if one label says so.  Without toxic rows the lexicon is empty and every text gets the base rate.
    """
    tables = Tables(docs.sparkSession, "toxicity")
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out("doc_id")).groupBy(
        "doc_id").agg(F.max("toxic").alias("toxic"))
    n = known.count()
    if n > rows:
        known = known.where(F.pmod(F.xxhash64("doc_id"), F.lit(n)) < rows)
    # bounded by ``rows``: a hash join that sends two numbers a row
    fit_rows = tables.write(docs.select("doc_id", "text").join(F.broadcast(known), "doc_id").select("text", "toxic"), "rows")
    sizes = {r.toxic > 0: r.n for r in fit_rows.groupBy((F.col("toxic") > 0).cast("int").alias("toxic")).agg(
        F.count(F.lit(1)).alias("n")).collect()}
    n_toxic, n_clean = sizes.get(True, 0), sizes.get(False, 0)
    lexicon = Lexicon([], [], [])
    if n_toxic:
        heads = fit_rows.mapInArrow(_prefixes, "head string, toxic bigint, clean bigint, whole bigint").groupBy("head").agg(
            *[F.sum(c).alias(c) for c in ("toxic", "clean", "whole")])
        share = n_toxic / (n_toxic + n_clean)
        both = F.col("toxic") + F.col("clean")
        # how surprising the head's split would be if it had nothing to do with toxicity (log likelihood ratio)
        evidence = (F.col("toxic") * F.log(F.col("toxic") / (both * share))
                    + F.col("clean") * F.log(F.greatest(F.col("clean"), F.lit(1)) / (both * max(1 - share, 1e-9))))
        telling = heads.where((F.col("toxic") >= 3) & (F.col("clean") * 8 <= F.col("toxic"))).where(evidence >= EVIDENCE)
        # bounded by ``rows``: heads of the texts learned from
        counts = telling.orderBy(F.desc("toxic"), "head").collect()
        # one short list for each of at most ``rows`` texts
        holders = fit_rows.where("toxic > 0").select("text").mapInArrow(
            _holders({r.head: i for i, r in enumerate(counts)}), "heads array<int>")
        lexicon = _lexicon(counts, [r.heads for r in holders.collect()], n_toxic, n_clean, terms)

    terms_of = docs.sparkSession.sparkContext.broadcast(lexicon)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _texts(batch, "text"):
                seen: dict = defaultdict(lambda: [0, 0])
                for found, toxic in zip(cells(terms_of.value, texts), part.column("toxic").to_pylist()):
                    if toxic:
                        # what a term itself explains says nothing for the near misses beside it
                        found = {c for c in found if not c[1] and not c[2]} or found
                    for c in found or {(-1, 0, False)}:
                        seen[c][0 if toxic else 1] += 1
                if seen:
                    keys = list(seen)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k[0] for k in keys], pa.int32()), pa.array([k[1] for k in keys], pa.int32()),
                         pa.array([k[2] for k in keys], pa.bool_()), pa.array([seen[k][0] for k in keys], pa.int64()),
                         pa.array([seen[k][1] for k in keys], pa.int64())], names=["term", "edits", "quoted", "toxic", "clean"])

    counted = fit_rows.mapInArrow(count, "term int, edits int, quoted boolean, toxic bigint, clean bigint").groupBy(
        "term", "edits", "quoted").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean")).collect()
    tables.drop("rows")
    terms_of.destroy()
    return _weigh(lexicon, counted, n_toxic, n_clean)


def _weigh(lexicon: Lexicon, counted: list, n_toxic: int, n_clean: int) -> Model:
    odds = math.log((n_clean + 1) / (n_toxic + 1))
    seen = {(r.term, r.edits, r.quoted): (r.toxic, r.clean) for r in counted}
    weights = {}
    quotes = [v for k, v in seen.items() if k[2]]
    toxic_q, clean_q = sum(v[0] for v in quotes), sum(v[1] for v in quotes)
    for t in range(len(lexicon.terms)):
        for e in range(lexicon.limits[t] + 1):
            a, b = seen.get((t, e, False), (0, 0))
            # a near miss is taken for the term itself until clean documents hold it too
            trust = 5.0 if e < 2 else 2.0
            w = math.log((a + trust) / (b + 0.5)) + odds
            weights[t, e, False] = max(0.0, min(12.0, w))
            # quotations are too few to be weighed term by term
            quoted = math.log((toxic_q + 1) / (clean_q + 1)) + odds
            weights[t, e, True] = max(0.0, min(weights[t, e, False], quoted))
    # texts without a telling hit: those without any hit stand for them
    a, b = seen.get((-1, 0, False), (n_toxic, n_clean))
    return Model(lexicon, weights, -odds, min(-odds, math.log((a + 0.5) / (b + 0.5))))


def held_out(key: str):
    """Rows that are kept from learning; a null key is not."""
    return F.coalesce(F.crc32(F.col(f"`{key}`").cast("string").cast("binary")) % 3 == 1, F.lit(False))


def toxicity_scores(docs: DataFrame, model: Model, text: str = "text", score: str = "score") -> DataFrame:
    """All columns of ``docs`` and the column ``score`` (an input column of that name is replaced).

    Every whole text is read.  Null and empty texts get the score of a text without hits; equal texts get
    equal scores.  An empty table gives an empty result.
    """
    ship_package(docs.sparkSession)
    names = [c for c in docs.columns if c != score]
    rows = docs.select(*[F.col(f"`{c}`") for c in names])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields) + f", `{score}` double"
    # the model is bounded by its number of terms
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, texts in _texts(batch, text):
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(shared.value.score(texts), pa.float64())],
                                                 names=[*names, score])

    return rows.mapInArrow(run, schema)
