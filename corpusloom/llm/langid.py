"""Language identification by interpolated Kneser-Ney character models.

A text becomes symbols: lower-cased letters, each letter of the training sample as a symbol
of its own and one for all letters never seen there, and one symbol for every run of
anything else.  Each language has a character model of order 4 with interpolated Kneser-Ney
smoothing, kept as sorted arrays of n-gram codes with their discounted shares and the
weights of their contexts.  A text goes to the language with the lowest cross-entropy per
symbol.  A temperature fitted on rows that the models have not seen turns the gaps into a
probability, and a bound on the cross-entropy marks texts that look like no language.
"""

from __future__ import annotations

import math
import pickle
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusloom.llm.common import fresh

ORDER = 4
BITS = 16  # of a symbol: 0 is the boundary, 1 a letter never seen, the rest are the taught letters
#: Taught letters with symbols of their own; of more, the rarest count as never seen.
MAX_LETTERS = (1 << BITS) - 2
UNDETERMINED = "und"
#: Labelled rows per language that train the models; as many again calibrate.
ROWS_PER_LANGUAGE = 400
#: Bytes of text that train and calibrate a language; texts are whole, and one of each is always taken.
BYTES_PER_LANGUAGE = 4 << 20
#: Languages that a model tells apart; more are refused.
MAX_LANGUAGES = 1000
#: Scores that a worker keeps, over all codes and languages.
KEPT_SCORES = 1 << 24


@lru_cache(maxsize=1)
def folded() -> np.ndarray:
    """The lower-case letter of every code point, 0 for what is no letter."""
    table = np.zeros(0x110000, np.uint32)
    for cp in range(0x110000):
        c = chr(cp)
        if c.isalpha():
            table[cp] = ord(c.lower()[0])
    return table


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def alphabet(texts: list[str]) -> np.ndarray:
    """The lower-cased letters of the texts, most frequent first."""
    counts = np.zeros(0x110000, np.int64)
    for text in texts:
        letters, n = np.unique(folded()[_points(text)], return_counts=True)
        counts[letters] += n
    counts[0] = 0
    order = np.argsort(-counts, kind="stable")
    return order[: min(int((counts > 0).sum()), MAX_LETTERS)]


def symbol_table(letters: np.ndarray) -> np.ndarray:
    """The symbol of every code point."""
    number = np.ones(0x110000, np.uint16)
    number[letters] = np.arange(2, len(letters) + 2)
    number[0] = 0
    return number[folded()]


def symbols(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-gram codes of all texts, each text's first code, and its number of letters.

    Before each text stand as many boundaries as a context is long.
    """
    gap = "\n" * (ORDER - 1)
    joined = gap + gap.join(texts) + gap
    raw = table[_points(joined)]
    lengths = np.fromiter((len(t) for t in texts), np.int64, len(texts))
    begins = np.concatenate([[0], np.cumsum(lengths + ORDER - 1)]) + ORDER - 1  # first character of each text
    keep = raw != 0
    keep[1:] |= raw[:-1] != 0
    for k in range(1, ORDER):
        keep[begins - k] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    kept = raw[keep].astype(np.uint64)
    codes = kept.copy()
    for k in range(1, ORDER):
        codes[k:] |= kept[:-k] << np.uint64(BITS * k)
    letters = np.concatenate([[0], np.cumsum(raw != 0)])
    firsts = place[begins]
    return codes, firsts, letters[begins[1:] - (ORDER - 1)] - letters[begins[:-1]]


class Model:
    """One language: per order, sorted codes with shares, and sorted contexts with weights."""

    def __init__(self, codes: np.ndarray, n_symbols: int):
        self.n_symbols = n_symbols
        grams, counts = np.unique(codes, return_counts=True)
        self.levels = []
        for order in range(ORDER, 0, -1):
            n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
            discount = n1 / (n1 + 2 * n2) if n1 and n2 else 0.5
            contexts, first = np.unique(grams >> BITS, return_index=True)
            totals = np.add.reduceat(counts, first) if len(first) else counts[:0]
            kinds = np.diff(np.append(first, len(grams)))
            shares = np.maximum(counts - discount, 0) / np.repeat(totals, kinds)
            self.levels.append((grams, shares.astype(np.float64), contexts, discount * kinds / totals))
            # lower orders count in how many contexts a gram goes on
            grams, counts = np.unique(grams & ((1 << BITS * (order - 1)) - 1), return_counts=True)

    def log_prob(self, codes: np.ndarray) -> np.ndarray:
        p = np.full(len(codes), 1.0 / self.n_symbols)
        for order, (grams, shares, contexts, weights) in zip(range(1, ORDER + 1), reversed(self.levels)):
            part = codes & ((1 << BITS * order) - 1)
            p = p * _lookup(contexts, weights, part >> BITS, 1.0) + _lookup(grams, shares, part, 0.0)
        return np.log(p)


def _slot(codes: np.ndarray, bits: int) -> np.ndarray:
    return (codes * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)


def _lookup(keys: np.ndarray, values: np.ndarray, wanted: np.ndarray, missing: float) -> np.ndarray:
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return np.where(keys[at] == wanted, values[at], missing)


class Identifier:
    """The models of all languages with their letters and a worker's cache of scores by code."""

    def __init__(self, languages: list[str], models: list[Model], letters: np.ndarray,
                 temperature: float = 1.0, bound: float = math.inf):
        self.languages, self.models, self.letters = languages, models, letters
        self.temperature, self.bound = temperature, bound
        self._forget()

    def __getstate__(self):
        return self.languages, self.models, self.letters, self.temperature, self.bound

    def __setstate__(self, state):
        self.languages, self.models, self.letters, self.temperature, self.bound = state
        self._forget()

    def _forget(self) -> None:
        self.table = self.cached = None

    def _scores(self, codes: np.ndarray) -> np.ndarray:
        """Rows of log probabilities (one per language) of the codes.

        A code has one slot in the cache, by hash; codes not found there are worked out and
        take their slots, so the cache never grows.
        """
        bits = int(math.log2(max(KEPT_SCORES // len(self.models), 2)))
        if self.cached is None:
            self.cached = np.zeros(1 << bits, np.uint64)
            self.rows = np.empty((1 << bits, len(self.models)), np.float32)
            self.filled = np.zeros(1 << bits, bool)
        slots = _slot(codes, bits)
        missed = np.flatnonzero((self.cached[slots] != codes) | ~self.filled[slots])
        out = self.rows[slots]
        if len(missed):
            new, inverse = np.unique(codes[missed], return_inverse=True)
            rows = np.stack([model.log_prob(new) for model in self.models], 1).astype(np.float32)
            out[missed] = rows[inverse]
            places, first = np.unique(_slot(new, bits), return_index=True)
            self.cached[places], self.rows[places], self.filled[places] = new[first], rows[first], True
        return out

    def entropies(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Cross-entropy per symbol by text and language, symbols, and letters."""
        if self.table is None:
            self.table = symbol_table(self.letters)
        codes, firsts, letters = symbols(texts, self.table)
        out = np.zeros((len(texts), len(self.models)))
        sizes = np.diff(firsts)
        step = max(1, min(1 << 20, KEPT_SCORES // len(self.models)))
        for at in range(int(firsts[0]), int(firsts[-1]), step):
            end = min(at + step, int(firsts[-1]))
            cuts = np.concatenate([[at], firsts[(firsts > at) & (firsts < end)]])
            sums = np.add.reduceat(self._scores(codes[at:end]), cuts - at, axis=0, dtype=np.float64)
            np.subtract.at(out, np.searchsorted(firsts, cuts, "right") - 1, sums)
        return out / np.maximum(sizes, 1)[:, None], sizes, letters

    def posterior(self, entropies: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        scaled = -entropies * (self.temperature * np.sqrt(np.maximum(sizes, 1)))[:, None]
        scaled -= scaled.max(1, keepdims=True)
        odds = np.exp(scaled)
        return odds / odds.sum(1, keepdims=True)

    def calibrate(self, texts: list[str], truth: list[str]) -> None:
        """Temperature by least log loss; the bound leaves out one calibration text in a thousand."""
        entropies, sizes, letters = self.entropies(texts)
        index = {name: k for k, name in enumerate(self.languages)}
        known = np.array([k for k, t in enumerate(truth) if t in index and letters[k]], np.int64)
        if not len(known):
            return
        wanted = np.array([index[truth[k]] for k in known])
        losses = {}
        for temperature in np.geomspace(0.05, 50, 25):
            self.temperature = float(temperature)
            p = self.posterior(entropies[known], sizes[known])[np.arange(len(known)), wanted]
            losses[self.temperature] = float(-np.log(np.maximum(p, 1e-12)).mean())
        self.temperature = min(losses, key=losses.get)
        self.bound = float(np.quantile(entropies[known].min(1), 0.999))


def fit(docs: DataFrame, learn: Column, rows_per_language: int = ROWS_PER_LANGUAGE, text_column: str = "text",
        lang_column: str = "lang", id_column: str = "doc_id") -> Identifier | None:
    """Train on at most ``rows_per_language`` rows of each language and calibrate on as many others.

    Rows count by a hash of id and text, so the sample does not depend on the order of the
    table, and equal rows count once.  Both halves together take whole texts up to
    BYTES_PER_LANGUAGE, two at least.  Rows with a null language or text teach nothing.
    None if nothing teaches; more than MAX_LANGUAGES languages are refused.
    """
    usable = docs.where(learn & F.col(lang_column).isNotNull() & F.col(text_column).isNotNull())
    usable = usable.select(
        F.col(lang_column).alias("lang"), F.col(text_column).alias("text"),
        F.pmod(F.xxhash64(F.col(id_column), F.col(text_column)), F.lit(1 << 60)).alias("u"))
    counted = usable.groupBy("lang").agg(F.approx_count_distinct("u", 0.02).alias("n")).limit(MAX_LANGUAGES + 1).collect()
    totals = {r["lang"]: r["n"] for r in counted}
    if not totals:
        return None
    if len(totals) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    wanted = 2 * rows_per_language

    def below(bounds: dict[str, int]) -> DataFrame:
        found = F.element_at(F.create_map(*[x for lang, n in bounds.items() for x in (F.lit(lang), F.lit(n).cast("long"))]), F.col("lang"))
        return usable.where(F.col("u") <= found).dropDuplicates(["lang", "u"])

    rates = {lang: int(min(1.0, 1.5 * wanted / n) * (1 << 60)) for lang, n in totals.items()}
    bounds: dict[str, int] = {}
    room: dict[str, list[int]] = {}
    for lang, u, size in sorted(tuple(r) for r in below(rates).select("lang", "u", F.octet_length("text")).collect()):
        rows, taken = room.setdefault(lang, [0, 0])
        if rows < 2 or (rows < wanted and taken + size <= BYTES_PER_LANGUAGE):
            bounds[lang], room[lang] = u, [rows + 1, taken + size]
        else:
            room[lang] = [wanted, taken]  # later rows do not come in
    rows = sorted((r["lang"], r["u"], r["text"]) for r in below(bounds).collect())
    taught: dict[str, list[str]] = {}
    checks: list[tuple[str, str]] = []
    sizes = {lang: sum(1 for x in rows if x[0] == lang) for lang in bounds}
    for lang, _, text in rows:
        own = taught.setdefault(lang, [])
        if len(own) < max(1, sizes[lang] // 2):
            own.append(text)
        else:
            checks.append((lang, text))
    letters = alphabet([text for texts in taught.values() for text in texts])
    table = symbol_table(letters)
    languages, models = [], []
    for lang, texts in sorted(taught.items()):
        codes, firsts, found = symbols(texts, table)
        if found.sum():
            languages.append(lang)
            models.append(Model(codes[firsts[0] : firsts[-1]], len(letters) + 2))
    if not models:
        return None
    identifier = Identifier(languages, models, letters)
    identifier.calibrate([t for _, t in checks], [lang for lang, _ in checks])
    identifier._forget()
    return identifier


@lru_cache(maxsize=1)
def _loaded(packed: bytes) -> Identifier | None:
    return pickle.loads(packed)


def _predict(packed):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        identifier = _loaded(packed.value)
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                part = batch.slice(at, 512)
                texts = [t or "" for t in part.column(part.num_columns - 1).to_pylist()]
                names, scores, rejected = [UNDETERMINED] * len(texts), [0.0] * len(texts), [True] * len(texts)
                if identifier is not None:
                    entropies, sizes, letters = identifier.entropies(texts)
                    p = identifier.posterior(entropies, sizes)
                    best = entropies.argmin(1)
                    for k in np.flatnonzero(letters):
                        names[k] = identifier.languages[best[k]]
                        scores[k] = float(p[k, best[k]])
                        rejected[k] = bool(entropies[k, best[k]] > identifier.bound)
                arrays = [pa.array(names), pa.array(scores, pa.float64()), pa.array(rejected)]
                yield pa.record_batch([*part.columns[:-1], *arrays],
                                      names=[*part.schema.names[:-1], "lang_pred", "score", "rejected"])

    return run


def identify(docs: DataFrame, identifier: Identifier | None, text_column: str = "text") -> DataFrame:
    """The columns of ``docs`` but the text, plus lang_pred, score and rejected.

    Null texts and texts without a letter are ``und`` with score 0; all others get a learnt
    language, ``rejected`` if their cross-entropy is beyond the calibrated bound.  Without
    any model every text is ``und``.  Columns of these names are replaced.
    """
    made = ("lang_pred", "score", "rejected")
    text = fresh("text")
    rows = docs.select(
        *[F.col(f"`{c}`") for c in docs.columns if c != text_column and c not in made],
        F.col(text_column).cast("string").alias(text))
    packed = docs.sparkSession.sparkContext.broadcast(pickle.dumps(identifier))  # sized by the sample
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]),
                        "lang_pred string, score double, rejected boolean"])
    return rows.mapInArrow(_predict(packed), schema)
