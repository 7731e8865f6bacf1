"""Toxicity of texts, with noisy-channel deobfuscation.

A token that isn't plainly a word (leetspeak, inner punctuation, a letter three times in a row,
letters spaced out) is a lattice of characters: at each place a character stands for itself, for a
letter that it looks like, for the letter before it once more, or for nothing.  Viterbi decoding
finds the most likely letters under a character trigram model that was counted on the plain words
of all texts, labelled or not.  The restored text is scored by logistic regression on the presence of its
words and of their first letters (stems, for inflected words).  Not decoded: look-alikes at a token's
end, which are stripped like punctuation (so "a$$" reads "a"); tokens without any letter, as most are
numbers; and letters doubled where a word has one, as most doubled letters belong there.

The regression is fitted on at most ``sample_rows`` labelled rows, those smallest by a hash of
doc_id.  Scoring reads whole texts, and nothing but texts.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .columns import byte_sizes, byte_strings, frugal, pieces, runs
from .common import Workspace, text_or_empty

#: Letters that a character is written for.
LOOKS_LIKE = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b", "9": "g",
    "@": "a", "$": "s", "!": "il", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i",
}
#: Punctuation that ends up around words.
AROUND = ".,;:!?%&*#$|\"'()[]{}<>-_~/\\^`´“”„«»…¿¡"
STEMS = (4, 5)
#: Costs of the channel in nats: a look-alike, a character for nothing, a letter once more.
SWAP, DROP_PUNCTUATION, DROP_OTHER, REPEAT = 0.7, 0.3, 6.0, 0.5


class CharModel:
    """Log probabilities of a letter after two others; '^' starts and '$' ends a word."""

    def __init__(self, counts: dict[str, int]):
        self.counts = counts
        self.pairs: dict[str, int] = {}
        for tri, n in counts.items():
            self.pairs[tri[:2]] = self.pairs.get(tri[:2], 0) + n
        self.letters = max(2, len({t[2] for t in counts}))

    def log(self, before: str, letter: str) -> float:
        return math.log((self.counts.get(before + letter, 0) + 0.05) / (self.pairs.get(before, 0) + 0.05 * self.letters))


def trigrams(word: str) -> list[str]:
    padded = "^^" + word + "$"
    return [padded[i : i + 3] for i in range(len(padded) - 2)]


def decode(token: str, model: CharModel) -> str:
    """The most likely letters for a token, by Viterbi over its lattice; a state is the last two
    letters with the last character read as it was written."""
    states: dict[tuple[str, str], tuple[float, tuple | None]] = {("^^", ""): (0.0, None)}
    for c in token:
        after: dict[tuple[str, str], tuple[float, tuple | None]] = {}

        def reach(state: tuple[str, str], cost: float, path: tuple | None) -> None:
            if state not in after or cost < after[state][0]:
                after[state] = (cost, path)

        letters = [(c, 0.0)] if c.isalpha() else [(x, SWAP) for x in LOOKS_LIKE.get(c, "")]
        for (last, raw), (cost, path) in states.items():
            for letter, channel in letters:
                reach((last[1] + letter, c), cost + channel - model.log(last, letter), (letter, path))
                if raw == c and last[1] == letter:
                    reach((last, c), cost + REPEAT, path)
            if not c.isalpha():
                reach((last, raw), cost + (DROP_OTHER if c in LOOKS_LIKE else DROP_PUNCTUATION), path)
        states = after or states
    _, (_, path) = min(states.items(), key=lambda s: s[1][0] - model.log(s[0][0], "$"))
    out = []
    while path:
        letter, path = path
        out.append(letter)
    return "".join(reversed(out))


def restored(token: str, model: CharModel) -> str:
    """A lower-case token as a word."""
    word = token.strip(AROUND)
    if word.isalpha():
        for i in range(len(word) - 2):
            if word[i] == word[i + 1] == word[i + 2]:
                return decode(word, model)
        lead = token[: len(token) - len(token.lstrip(AROUND))]
        if not lead or lead[-1] not in LOOKS_LIKE:
            return word
        return decode(lead[-1] + word, model)
    word = token.rstrip(AROUND) or token
    return decode(word, model) if any(c.isalpha() for c in word) else ""


def tokens(text: str) -> Iterator[str]:
    """Distinct lower-case tokens, and the joined letters of words that are spaced out."""
    own = text.lower().split()
    yield from set(own)
    single = [i for i, t in enumerate(own) if len(t) == 1]
    start = 0
    for k in range(1, len(single) + 1):
        if k == len(single) or single[k] != single[k - 1] + 1:
            if k - start >= 3:
                yield "".join(own[i] for i in single[start:k])
            start = k


def names(word: str) -> list[str]:
    """A word's features: itself and its stems."""
    return ["=" + word, *[str(n) + word[:n] for n in STEMS if len(word) >= n]] if word else []


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 2e-4, steps: int = 600) -> np.ndarray:
    """Weights and, last, the intercept, by accelerated gradient descent on a 0/1 matrix."""
    n, d = x.shape
    z = np.ones(d + 1)  # power iteration: the largest curvature sets the step
    for _ in range(30):
        z /= np.linalg.norm(z)
        p = x @ z[:-1].astype(x.dtype) + z[-1].astype(x.dtype)
        z = np.append(x.T @ p, p.sum()).astype(np.float64)
    rate = 4.0 * n / float(np.linalg.norm(z)) / 1.05
    w = v = np.zeros(d + 1)
    for k in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ v[:-1].astype(x.dtype) + v[-1], -40, 40)))
        slope = np.append(x.T @ (p - y).astype(x.dtype), (p - y).sum()) / n
        slope[:-1] += ridge * v[:-1]
        new = v - rate * slope
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


def plain_words(strings: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Tokens without what is around them, and which of these ``restored`` would leave as they are."""
    import pyarrow.compute as pc

    words, behind = pc.utf8_trim(strings, AROUND), pc.utf8_ltrim(strings, AROUND)
    if not len(strings):
        return words, np.zeros(0, bool)
    size = pc.utf8_length(strings).to_numpy().astype(np.int64)
    text = np.frombuffer(b"".join(byte_strings(strings)).decode("utf-8", "replace").encode("utf-32-le"), np.uint32)
    start = np.cumsum(size) - size
    # a letter three times in a row, within one token
    at = np.flatnonzero((text[:-2] == text[1:-1]) & (text[1:-1] == text[2:])) if len(text) > 2 else np.zeros(0, np.int64)
    token = np.searchsorted(start, at, "right") - 1
    plain = pc.utf8_is_alpha(words).to_numpy(zero_copy_only=False).copy()
    plain[token[at + 2 < start[token] + size[token]]] = False
    # a look-alike right before the word
    lead = size - pc.utf8_length(behind).to_numpy()
    some = np.flatnonzero(plain & (lead > 0))
    plain[some[np.isin(text[start[some] + lead[some] - 1], np.array([ord(c) for c in LOOKS_LIKE], np.uint32))]] = False
    return words, plain


class Tokens:
    """The distinct tokens of each of some texts, as ``tokens`` gives them: texts' numbers and tokens'
    numbers in pairs, and the tokens (UTF-8)."""

    def __init__(self, row: np.ndarray, code: np.ndarray, own: list[bytes], strings: pa.Array):
        self.row, self.code, self.own, self.strings = row, code, own, strings


def tokens_of(texts: pa.Array, joined: bool = True) -> Iterator[tuple[int, int, Tokens]]:
    """(first, last, their tokens) of some texts at a time; with ``joined``, also the words that are
    spaced out."""
    import pyarrow.compute as pc

    for first, last in pieces(byte_sizes(texts)):
        parts = pc.utf8_split_whitespace(pc.utf8_lower(texts.slice(first, last - first)))
        flat = parts.flatten().dictionary_encode()
        row, code, strings = pc.list_parent_indices(parts).to_numpy().astype(np.int64), flat.indices.to_numpy().astype(np.int64), flat.dictionary
        own = byte_strings(strings)
        many = len(own)
        key = row * max(1, 2 * many) + code
        if joined and many:
            single = np.flatnonzero((pc.utf8_length(strings).to_numpy() == 1)[code])
            starts, sizes = runs(single - np.arange(len(single)) + row[single] * (len(row) + 1))
            new: dict[bytes, int] = {}
            more = []
            for a, n in zip(starts.tolist(), sizes.tolist(), strict=True):
                if n >= 3:
                    word = b"".join(own[c] for c in code[single[a : a + n]])
                    more.append(row[single[a]] * 2 * many + many + new.setdefault(word, len(new)))
            own, key = own + list(new), np.r_[key, np.array(more, np.int64)]
        key = np.sort(key)
        key = key[runs(key)[0]]
        row = key // max(1, 2 * many)
        yield first, last, Tokens(row, key - row * 2 * many, own, strings)


class Model:
    """Score of a text, and what it's made of."""

    def __init__(self, letters: CharModel, weights: dict[str, float], intercept: float, memory: int = 200_000):
        self.letters, self.weights, self.intercept, self.memory = letters, weights, intercept, memory
        self.number = {name: i for i, name in enumerate(weights)}
        self.values = np.array(list(weights.values()), np.float64)
        self.known: dict[bytes, tuple[int, ...]] = {}
        # the names of features by kind: whole words and stems
        self.kinds = [(n, pa.array([name[1:] for name in weights if name[0] == mark], pa.string()), np.array([i for name, i in self.number.items() if name[0] == mark], np.int64)) for n, mark in ((0, "="), *((k, str(k)) for k in STEMS))]

    def sent(self, spark: SparkSession):
        """A broadcast of plain values, which executors make into a model again."""
        return spark.sparkContext.broadcast((self.letters.counts, self.weights, self.intercept, self.memory))

    def of(self, token: bytes) -> tuple[int, ...]:
        """The numbers of a token's features."""
        found = self.known.get(token)
        if found is None:
            if len(self.known) >= self.memory:
                self.known.clear()
            word = restored(token.decode("utf-8", "replace"), self.letters)
            found = self.known[token] = tuple(self.number[n] for n in names(word) if n in self.number)
        return found

    def _features(self, found: Tokens) -> tuple[np.ndarray, np.ndarray]:
        """(token, feature) pairs; plain words are looked up together, others one by one."""
        import pyarrow.compute as pc

        words, plain = plain_words(found.strings)
        out = []
        at = np.flatnonzero(plain)
        words = words.take(pa.array(at))
        size = pc.utf8_length(words)
        for n, known, numbers in self.kinds:
            place = pc.index_in(pc.utf8_slice_codeunits(words, 0, n) if n else words, known)
            hit = pc.fill_null(pc.and_(pc.is_valid(place), pc.greater_equal(size, n)), False).to_numpy(zero_copy_only=False)
            out.append((at[hit], numbers[place.filter(pa.array(hit)).to_numpy(zero_copy_only=False)] if hit.any() else np.zeros(0, np.int64)))
        rest = [*np.flatnonzero(~plain).tolist(), *range(len(plain), len(found.own))]
        odd = [(k, n) for k in rest for n in self.of(found.own[k])]
        out.append((np.array([k for k, _ in odd], np.int64), np.array([n for _, n in odd], np.int64)))
        return np.concatenate([a for a, _ in out]), np.concatenate([b for _, b in out])

    def scores(self, texts: pa.Array) -> np.ndarray:
        out = np.zeros(len(texts))
        for first, last, found in tokens_of(texts):
            code, number = self._features(found)
            order = np.argsort(code, kind="stable")
            number = number[order]
            many = np.bincount(code, minlength=len(found.own))
            begin = np.cumsum(many) - many
            use = np.flatnonzero(many[found.code]) if len(many) else np.zeros(0, np.int64)
            row, code = found.row[use], found.code[use]
            each = many[code]
            place = np.repeat(begin[code], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
            # a feature counts once, and in one order: the same words give the same last digits
            key = np.unique(np.repeat(row, each) * max(1, len(self.values)) + number[place])
            z = np.bincount(key // max(1, len(self.values)), self.values[key % len(self.values)] if len(key) else None, last - first)
            out[first:last] = 1 / (1 + np.exp(-np.clip(self.intercept + z, -700, 700)))
        return out

    def score(self, text: str | None) -> float:
        return float(self.scores(pa.array([text or ""]))[0])


def received(held) -> Model:
    counts, weights, intercept, memory = held.value
    return Model(CharModel(counts), weights, intercept, memory)


def held_out(doc_id="doc_id"):
    """Rows whose labels are never learned from; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def count_trigrams(texts: DataFrame, held: int = 500_000) -> dict[str, int]:
    """How many times texts have a trigram in their distinct plain words, over all of ``texts``.

    A task adds up its trigrams and passes them on whenever it holds ``held``.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pyarrow.compute as pc

        keys, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def told() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(counts)], names=["tri", "n"])

        for batch in batches:
            for _, _, found in tokens_of(batch.column(0), joined=False):
                plain = pc.utf8_trim(found.strings, AROUND)
                use = np.flatnonzero(pc.utf8_is_alpha(plain).to_numpy(zero_copy_only=False))
                if not len(use):
                    continue
                plain = plain.take(pa.array(use))
                times = np.bincount(found.code, minlength=len(found.own))[use]
                # all words in a row, each between its marks: a trigram starts at every place but the last two
                padded = pc.binary_join_element_wise("^^", plain, "$", "")
                text = np.frombuffer(b"".join(byte_strings(padded)).decode("utf-8", "replace").encode("utf-32-le"), np.uint32).astype(np.int64)
                each = np.repeat(times, pc.utf8_length(padded).to_numpy())
                at = np.flatnonzero((text[:-2] != ord("$")) & (text[1:-1] != ord("$")))
                tri = text[at] << 42 | text[at + 1] << 21 | text[at + 2]
                sums = pa.table({"tri": np.r_[keys, tri], "n": np.r_[counts, each[at]]}).group_by("tri", use_threads=False).aggregate([("n", "sum")])
                keys, counts = sums.column("tri").to_numpy(), sums.column("n_sum").to_numpy()
                if len(keys) >= held:
                    yield told()
                    keys, counts = keys[:0], counts[:0]
        yield told()

    counted = texts.select("text").mapInArrow(frugal(count), "tri long, n long").groupBy("tri").agg(F.sum("n").alias("n")).toPandas()
    letters = (1 << 21) - 1
    return {chr(t >> 42) + chr(t >> 21 & letters) + chr(t & letters): n for t, n in zip(counted["tri"].tolist(), counted["n"].tolist(), strict=True)}


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, sample_rows: int = 12_000, features: int = 512) -> Model:
    """A model from ``docs`` (doc_id, text) and ``labels`` (doc_id, toxic).

    Labels that are null, not 0 or 1, or held out aren't learned from; of labels of one doc_id that
    disagree, 1 counts.  Without any left, every
    text scores as the empty prior, 0.5 at most.
    """
    space = Workspace(spark, "toxicity")
    usable = labels.filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out())
    usable = usable.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = usable.orderBy(F.xxhash64("labelled"), "labelled").limit(sample_rows)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    # at most sample_rows rows of two numbers: bounded, whatever the corpus.  An id may repeat in docs:
    # one text of it counts, so that the bound holds for the sample, too
    sample = texts.join(F.broadcast(chosen), F.col("doc_id") == F.col("labelled")).groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic"))
    sample = space.write(sample.repartition(24, "doc_id"), "sample")
    letters = CharModel(count_trigrams(texts))
    held = spark.sparkContext.broadcast(letters.counts)

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[bytes, list[str]] = {}
        letters = CharModel(held.value)
        for batch in batches:
            every: list[list[str]] = []
            for first, last, found in tokens_of(batch.column(1)):
                for token in found.own:
                    if token not in known:
                        known[token] = names(restored(token.decode("utf-8", "replace"), letters))
                own: list[set[str]] = [set() for _ in range(last - first)]
                for row, code in zip(found.row.tolist(), found.code.tolist(), strict=True):
                    own[row].update(known[found.own[code]])
                every += map(sorted, own)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(every, pa.list_(pa.string()))], names=["doc_id", "toxic", "names"])

    seen = space.write(sample.mapInArrow(frugal(present), "doc_id long, toxic int, names array<string>"), "seen")
    totals = seen.agg(F.count("*").alias("n"), F.sum("toxic").alias("toxic")).first()
    n, toxic = totals["n"], totals["toxic"] or 0
    if not n or toxic in (0, n):
        return Model(letters, {}, -5.0 if not toxic else 5.0)
    each = seen.select("toxic", F.explode("names").alias("name")).groupBy("name").agg(F.count("*").alias("all"), F.sum("toxic").alias("bad"))
    # how many standard deviations a feature's toxic share is from the whole sample's
    rate = toxic / n
    each = each.filter("all >= 4").withColumn("z", (F.col("bad") - F.col("all") * rate) / F.sqrt(F.col("all") * rate * (1 - rate)))
    best = [r["name"] for r in each.orderBy(F.desc(F.abs("z")), "name").limit(features).collect()]
    place = {name: i for i, name in enumerate(best)}
    x, y = np.zeros((n, len(best)), np.float32), np.zeros(n)
    chosen_names = F.array(*[F.lit(b) for b in best])
    rows = seen.select("doc_id", "toxic", F.array_intersect("names", chosen_names).alias("names")).orderBy("doc_id", "toxic")
    for k, r in enumerate(rows.collect()):
        y[k] = r["toxic"]
        x[k, [place[name] for name in r["names"]]] = 1
    w = fit_logistic(x, y)
    space.drop("sample", "seen")
    return Model(letters, {b: float(v) for b, v in zip(best, w[:-1], strict=True)}, float(w[-1]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, score (0 to 1) and predicted (0 or 1).

    Null and empty texts get the score of a text without features.  Repeated rows get equal
    scores.  An empty table gives an empty result.  Other columns, of any name, are not read.
    """

    held = model.sent(docs.sparkSession)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = received(held)
        for batch in batches:
            made = own.scores(batch.column(1))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made), pa.array((made >= 0.5).astype(np.int32))], names=["doc_id", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")).mapInArrow(frugal(scan), "doc_id long, score double, predicted int")


def keep_clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs`` that aren't predicted to be toxic, with all their columns."""
    from pyspark.sql.functions import arrow_udf

    held = model.sent(docs.sparkSession)

    @arrow_udf("boolean")
    def clean(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from scan(batches)

    def judge(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        own = received(held)
        for texts in batches:
            yield pa.array(own.scores(texts) < 0.5)

    scan = frugal(judge)
    return docs.filter(clean(text_or_empty()))
