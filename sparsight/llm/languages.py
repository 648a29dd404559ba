"""Language identification by cross-parsing: how few phrases of a language's labelled text a document needs.

Training takes a bounded sample of labelled rows a language (parameters below), whole, as one string of letters.
A suffix automaton of that string follows a document letter by letter; when no longer match exists a phrase ends and the
next one begins at that letter. Phrases per letter, times the log of the training size, estimate the cross entropy; the
language that needs fewest normalised phrases wins. All texts of a batch are parsed at once: they are cut into lanes of
letters, parsed as if a phrase began with each, and every step advances all lanes by one letter. Then the phrase that is
open at a lane's end goes on into the next lane until it meets a state that this was in anyway, which is soon; the result
is the parse of the whole text from its first letter on, whatever the lanes.
"""

from __future__ import annotations

import functools
import math
from array import array

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import give_memory_back, table

#: Bounds of the training sample: rows a language (the ones with the smallest hashes of ids), characters of each. Rows of
#: more are only taken where there are no others, and then by a passage at a place that the hash chooses.
SAMPLE_ROWS = 32
SAMPLE_CHARS = 4000
#: Letters of a lane; most letters of an alphabet whose transitions are a full table (larger ones are searched); bits by which a phrase more counts in the score.
LANE = 1024
FULL_TABLE = 120
PHRASE_BITS = 0.5
#: Code points that are parsed at once.
BATCH_CHARS = 1_000_000
#: A text of so many letters or more whose best language still needs a phrase for fewer letters than its bound is in no
#: known language. The bound lies midway between 1 (nothing matches) and what held-back labelled text reaches, within these.
LEAST_LETTERS = 24
LEAST_PHRASE = (1.02, 1.5)
UNKNOWN = "und"
RESULT = "struct<lang: string, score: double, phrases: bigint, letters: bigint, least: double>"
_END = np.uint32(1 << 31)


@functools.lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For every code point its lower-case letter; 32 (a space) for all that is no letter."""
    table_ = np.full(0x110000, 32, dtype=np.uint32)
    for c in range(0x110000):
        if (ch := chr(c)).isalpha():
            low = ch.lower()
            table_[c] = ord(low) if len(low) == 1 else c
    return table_


def letters_of(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Lower-case letters of all texts with one space between words, as code points, and where each text starts (one more for the end)."""
    points = np.frombuffer("".join(f"\n{t or ''}" for t in texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    starts = np.cumsum([0, *(1 + len(t or "") for t in texts)])
    folded = _folded()[points]
    space = folded == 32
    keep = ~space
    keep[:-1] |= space[:-1] & ~space[1:]  # the last of a run of spaces, before a letter
    at = np.concatenate([[0], np.cumsum(keep)])
    # a text's first space goes too, so that what is left begins with a letter
    first = starts[:-1]
    lead = _first_kept_is_space(folded, keep, at, first, starts[1:])
    keep[lead] = False
    at = np.concatenate([[0], np.cumsum(keep)])
    return folded[keep], at[starts]


def _first_kept_is_space(folded, keep, at, first, last):
    kept = np.flatnonzero(keep)
    has = at[last] > at[first]
    lead = kept[at[first][has]] if len(kept) else np.zeros(0, dtype=np.int64)
    return lead[folded[lead] == 32]


def suffix_automaton(symbols: np.ndarray, size: int) -> np.ndarray:
    """states x size transitions of the suffix automaton of a symbol sequence; 0, the root, where there is none.

    States of short matches, which texts are in most of the time, come first, so that they lie close together.
    """
    n = len(symbols)
    trans = array("i", bytes(4 * size * (2 * n + 2)))
    link, length = array("i", [-1]) + array("i", bytes(4 * (2 * n + 1))), array("i", bytes(4 * (2 * n + 2)))
    last, used = 0, 1
    for c in symbols.tolist():
        cur, used = used, used + 1
        length[cur] = length[last] + 1
        p = last
        while p != -1 and not trans[p * size + c]:
            trans[p * size + c] = cur
            p = link[p]
        if p == -1:
            link[cur] = 0
        else:
            q = trans[p * size + c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone, used = used, used + 1
                length[clone], link[clone] = length[p] + 1, link[q]
                trans[clone * size : (clone + 1) * size] = trans[q * size : (q + 1) * size]
                while p != -1 and trans[p * size + c] == q:
                    trans[p * size + c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    order = np.argsort(np.frombuffer(length, dtype=np.int32)[:used], kind="stable")
    number = np.empty(used, dtype=np.int32)
    number[order] = np.arange(used, dtype=np.int32)
    return number[np.frombuffer(trans, dtype=np.int32)[: used * size].reshape(used, size)[order]]


def sparse_automaton(symbols: np.ndarray) -> list[dict[int, int]]:
    """The transitions of the same automaton, a dict a state, whatever the size of the alphabet."""
    trans, link, length, last = [{}], [-1], [0], 0
    for c in symbols.tolist():
        cur = len(trans)
        trans.append({})
        link.append(0)
        length.append(length[last] + 1)
        p = last
        while p != -1 and c not in trans[p]:
            trans[p][c] = cur
            p = link[p]
        if p != -1:
            q = trans[p][c]
            if length[p] + 1 == length[q]:
                link[cur] = q
            else:
                clone = len(trans)
                trans.append(dict(trans[q]))
                link.append(link[q])
                length.append(length[p] + 1)
                while p != -1 and trans[p].get(c) == q:
                    trans[p][c] = clone
                    p = link[p]
                link[q] = link[cur] = clone
        last = cur
    return trans


class _Full:
    """Steps from a full table; states are held as places of their rows."""

    def __init__(self, known: np.ndarray, size: int):
        states = suffix_automaton(known, size + 1)[:, :size]
        # one state more, for letters that the language lacks: whatever comes next begins a phrase
        lost = len(states)
        states = np.vstack([states, np.zeros((1, size), states.dtype)])
        restart = (np.where(states[0] == 0, lost, states[0]).astype(np.uint32) * np.uint32(size)) | _END
        step = np.where(states == 0, restart[None, :], states.astype(np.uint32) * np.uint32(size))
        self.step = np.ascontiguousarray(step).reshape(-1)

    def next(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        return self.step[state + symbol]


class _Sparse:
    """Steps found by search among the transitions that there are; states are held as their numbers."""

    def __init__(self, known: np.ndarray, size: int):
        trans = sparse_automaton(known)
        pairs = sorted((s * size + c, to) for s, own in enumerate(trans) for c, to in own.items() if c < size)
        self.size = size
        self.keys = np.array([k for k, _ in pairs] + [np.iinfo(np.int64).max], dtype=np.int64)
        self.to = np.array([to for _, to in pairs] + [0], dtype=np.uint32)
        self.restart = np.full(size, len(trans), dtype=np.uint32)
        for c, to in trans[0].items():
            if c < size:
                self.restart[c] = to
        self.restart |= _END

    def next(self, state: np.ndarray, symbol: np.ndarray) -> np.ndarray:
        wanted = state.astype(np.int64) * self.size + symbol
        at = np.searchsorted(self.keys, wanted)
        return np.where(self.keys[at] == wanted, self.to[at], self.restart[symbol])


class Parser:
    """Automata of several languages, ready to count the phrases of many texts at once."""

    def __init__(self, samples: tuple[tuple[str, str], ...]):
        """samples: (language, its training letters, texts apart by line feeds), in order of language."""
        self.languages = [lang for lang, _ in samples]
        kept = sorted(set().union(*(letters for _, letters in samples)) - {"\n"})
        # numbers of all languages' letters, then each language's symbols: 0 matches nothing, 1 and up are letters and the space
        self.number = np.zeros(0x110000, dtype=np.uint32)
        self.number[[ord(ch) for ch in kept]] = np.arange(1, len(kept) + 1)
        self.symbols, self.tables, self.log_size = [], [], []
        for _, letters in samples:
            points = np.frombuffer(letters.encode("utf-32-le"), dtype=np.uint32)
            own = np.unique(points[points != 10])
            symbols = np.zeros(len(kept) + 1, dtype=np.uint32)
            symbols[self.number[own]] = np.arange(1, len(own) + 1)
            size = len(own) + 1
            # the texts of the sample are kept apart by a symbol of their own that no document has
            known = symbols[self.number[points]].astype(np.int64)
            known[points == 10] = size
            self.symbols.append(symbols)
            self.tables.append((_Full if len(own) <= FULL_TABLE else _Sparse)(known, size))
            self.log_size.append(math.log2(len(points) + 2))

    def phrases(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """texts x languages phrase counts, and how many letters each text has."""
        points, bounds = letters_of(texts)
        sizes = np.diff(bounds)
        lanes = -(-sizes // LANE)
        total = int(lanes.sum())
        counts = np.zeros((len(texts), len(self.languages)), dtype=np.int64)
        if not total or not self.languages:
            return counts, sizes
        owner = np.repeat(np.arange(len(texts)), lanes)
        nth = np.arange(total) - np.repeat(np.cumsum(lanes) - lanes, lanes)
        begin = bounds[:-1][owner] + nth * LANE
        end = np.minimum(begin + LANE, bounds[1:][owner])
        later = np.flatnonzero(nth > 0)  # lanes that another one precedes
        last = np.append(nth[1:] == 0, True)
        order = np.argsort(begin - end, kind="stable")  # longest first, so that ended lanes are cut off
        by_length, length = begin[order], (end - begin)[order]
        column = np.empty(total, dtype=np.int64)
        column[order] = np.arange(total)
        active = np.searchsorted(-length, -np.arange(int(length[0])), side="left")  # lanes longer than t
        step = np.concatenate([[0], np.cumsum(active)])  # where the t-th letters of all lanes begin: letters of one step lie together
        numbers = np.empty(len(points), dtype=np.uint32)
        for t, n in enumerate(active):
            numbers[step[t] : step[t + 1]] = self.number[points[by_length[:n] + t]]
        opening = column[nth == 0]
        for k, table_ in enumerate(self.tables):
            symbols = self.symbols[k][numbers]
            path = np.empty(len(points), dtype=np.uint32)  # the state after each letter, marked where a phrase begins with it
            state = np.zeros(total, dtype=np.uint32)
            for t, n in enumerate(active):
                at = slice(step[t], step[t + 1])
                path[at] = state = table_.next(state[:n] & ~_END, symbols[at])
            lane = later
            while len(lane):
                before = lane - 1
                state = path[step[end[before] - begin[before] - 1] + column[before]] & ~_END
                lane = np.sort(self._go_on(table_, symbols, path, step, lane, state, column, end - begin))
                lane = lane[~last[lane]] + 1  # lanes whose predecessor ended in another state than was thought
            path[opening] |= _END
            begun = np.zeros(total, dtype=np.int64)
            for t, n in enumerate(active):
                begun[:n] += path[step[t] : step[t + 1]] >> np.uint32(31)
            counts[:, k] = np.bincount(owner[order], weights=begun, minlength=len(texts)).astype(np.int64)
        return counts, sizes

    @staticmethod
    def _go_on(table_, symbols, path, step, lane, state, column, length) -> np.ndarray:
        """Parses lanes from the states given, up to states that they were in before; returns those that never were."""
        changed, t = [lane[:0]], 0
        place, length = column[lane], length[lane]
        while len(lane):
            met = np.zeros(len(lane), bool)
            until = min(t + 16, int(length.min()))
            while t < until:  # going on behind a state that was met changes nothing
                at = step[t] + place
                v = table_.next(state, symbols[at])
                state = v & ~_END
                met |= state == path[at] & ~_END
                path[at] = v
                t += 1
            changed.append(lane[(length == t) & ~met])
            on = ~met & (length > t)
            lane, place, length, state = lane[on], place[on], length[on], state[on]
        return np.concatenate(changed)

    def identify(self, texts: list[str | None]) -> list[tuple[str, float, int, int]]:
        counts, sizes = self.phrases(texts)
        out = []
        for row, letters in zip(counts, sizes.tolist()):
            if not letters or not len(row):
                out.append((UNKNOWN, 0.0, 0, letters))
                continue
            bits = row * np.array(self.log_size)
            best = int(np.argmin(bits))
            share = 2.0 ** -np.minimum(PHRASE_BITS * (bits - bits[best]) / self.log_size[best], 1000)
            out.append((self.languages[best], float(1 / share.sum()), int(row[best]), letters))
        return out


@functools.lru_cache(maxsize=2)
def _parser(samples: tuple[tuple[str, str], ...]) -> Parser:
    return Parser(samples)


@functools.lru_cache(maxsize=2)
def least_phrases(samples: tuple[tuple[str, str], ...]) -> dict[str, float]:
    """Letters a phrase that a text of each language needs, from how one half of its sample is parsed by the other."""
    out = {}
    for lang, letters in samples:
        texts = letters.split("\n")
        if len(texts) == 1:
            texts = [letters[: len(letters) // 2], letters[len(letters) // 2 :]]
        held_back = texts[1::2]
        counts, sizes = Parser(((lang, "\n".join(texts[::2])),)).phrases(held_back)
        reached = sizes.sum() / max(1, counts.sum())
        out[lang] = float(np.clip((1 + reached) / 2, *LEAST_PHRASE))
    return out


def training_samples(labelled: DataFrame, id_column: str = "doc_id", text_column: str = "text", lang_column: str = "lang") -> tuple[tuple[str, str], ...]:
    """(language, letters) of at most SAMPLE_ROWS labelled rows a language, chosen by the hash of their ids.

    Rows without text or label take no part. What reaches the driver is bounded by languages x SAMPLE_ROWS x SAMPLE_CHARS
    characters; each row of the sample is the one with the smallest hash in its slot, found by aggregation.
    """
    chance = F.xxhash64(F.lit(11), F.col(id_column))
    size = F.char_length(text_column)
    place = F.when(size > SAMPLE_CHARS, F.pmod(chance, size - SAMPLE_CHARS + 1)).otherwise(0).cast("int")
    picked = (
        labelled.where(F.col(text_column).isNotNull() & F.col(lang_column).isNotNull())
        .select(F.col(lang_column).alias("lang"), F.pmod(chance, F.lit(SAMPLE_ROWS)).alias("slot"), F.struct((size > SAMPLE_CHARS).alias("long"), chance.alias("h"), F.col(id_column).cast("string").alias("id"), F.substring(text_column, place + 1, F.lit(SAMPLE_CHARS)).alias("text")).alias("row"))
        .groupBy("lang", "slot").agg(F.min("row").alias("row"))
        .select("lang", "slot", F.col("row.text").alias("text"))
    )
    by_lang: dict[str, list[str]] = {}
    for r in sorted(picked.collect(), key=lambda r: (r.lang, r.slot)):
        points, _ = letters_of([r.text])
        if len(points):
            by_lang.setdefault(r.lang, []).append(points.astype("<u4").tobytes().decode("utf-32-le"))
    return tuple((lang, "\n".join(texts)) for lang, texts in sorted(by_lang.items()))


def language_of(column: Column, samples: tuple[tuple[str, str], ...]) -> Column:
    """struct(lang, score, phrases, letters, least) of a text column; `und` with score 0 for null and for texts without letters.

    `least` are the letters a phrase that `is_known` asks of a text in that language.
    """
    least = least_phrases(samples)

    @F.arrow_udf(RESULT)
    def lang(texts: pa.Array) -> pa.Array:
        give_memory_back()
        parser, rows = _parser(samples), []
        held, size = [], 0
        for text in texts:
            text = text.as_py()
            held.append(text)
            size += len(text or "")
            if size > BATCH_CHARS:  # bounds the working arrays
                rows += parser.identify(held)
                held, size = [], 0
        rows += parser.identify(held) if held else []
        cols = list(zip(*rows)) or [(), (), (), ()]
        return pa.StructArray.from_arrays(
            [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.float64()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.int64()), pa.array([least.get(x, LEAST_PHRASE[1]) for x in cols[0]], pa.float64())],
            names=["lang", "score", "phrases", "letters", "least"],
        )

    # an optimizer that took it for cheap would run it once for a filter and once more for the result
    return lang.asNondeterministic()(column)


def is_known(found: Column) -> Column:
    """Whether a text is in one of the learned languages: it has letters, and unless it is very short, phrases of more than single letters."""
    return (found.lang != UNKNOWN) & ((found.letters < LEAST_LETTERS) | (found.letters >= found.least * found.phrases))


def in_fold(id_column: str, folds: int, fold: int) -> Column:
    return F.crc32(F.col(id_column).cast("string").cast("binary")) % folds == fold


def op7_cross_parsing(spark, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from two of three folds; a null id is in no held-out fold."""
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(in_fold("doc_id", 3, 1), F.lit(False))
    samples = training_samples(docs.where(~held_out))
    found = docs.select("doc_id", held_out.alias("held_out"), language_of(F.col("text"), samples).alias("l"))
    return found.select("doc_id", "held_out", F.col("l.lang").alias("lang_pred"), F.col("l.score").alias("score"), F.col("l.phrases").alias("phrases"), F.col("l.letters").alias("letters"))
