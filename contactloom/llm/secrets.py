"""Secret scans: a random forest removes false positives.

Candidates are long strings over the letters of keys that hold a digit, and values that follow a
credential's name.  Each gets features: its length; how often it passes between kinds of characters
and how unusual its letter pairs are; how much of it dictionary words cover; whether it stands in
a path, an address or an assignment; and which words are near.  A random forest, trained from
labelled findings, says which candidates are secrets.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_RUN = re.compile(r"[A-Za-z0-9_+/=.@:~-]++")
_DIGIT = re.compile(r"[0-9]")
#: A name is looked at from its start alone and read whole, so a long one takes one pass.
_NAMED = re.compile(r"(?i)(?<!\w)(?=[a-z_]*?(?:password|passwd|secret|token|api_?key|access_?key|auth))[a-z_]++[\"']?\s{0,3}[:=]\s{0,3}[\"']?([^\s\"'|,;]{6,})")
_WORD = re.compile(r"[A-Za-z]{3,}")
_VALUE = re.compile(r"^[A-Za-z_]+[=:]+(?=.{6,})")
#: Words near a secret, and near a string that only looks like one.
GOOD_CUES = ("password", "passwd", "pwd", "secret", "token", "key", "apikey", "api_key", "access", "auth", "credential", "bearer")
BAD_CUES = ("commit", "hash", "md5", "sha", "sha1", "sha256", "checksum", "digest", "uuid", "version", "example", "sample", "placeholder", "page", "isbn", "file", "path", "build", "id")
FEATURES = (
    "length", "digits", "upper", "lower", "other", "kinds", "passes", "entropy", "pairs", "dictionary", "longest_run",
    "hexadecimal", "slashes", "dots", "at", "in_address", "assigned", "quoted", "good_near", "bad_near", "known_prefix", "repeats",
)
#: How well-known kinds of keys begin.
PREFIXES = ("AKIA", "ASIA", "ghp_", "gho_", "github_pat_", "xoxb-", "xoxp-", "sk-", "sk_live_", "rk_live_", "AIza", "eyJ", "glpat-", "npm_")


class Dictionary:
    """Words and letter pairs of a public vocabulary's plain words."""

    def __init__(self, words: list[str]):
        self.words = {w for w in words if len(w) >= 4}
        self.longest = max(map(len, self.words), default=0)
        self.pairs: dict[str, int] = {}
        for w in words:
            for i in range(len(w) - 1):
                self.pairs[w[i : i + 2]] = self.pairs.get(w[i : i + 2], 0) + 1
        self.total = sum(self.pairs.values())

    @classmethod
    def public(cls, json_path: str | None = None) -> Dictionary:
        import json

        if json_path is None:
            import public_tokenizers

            json_path = public_tokenizers.path("byte_bpe_50k.json")
        with open(json_path, encoding="utf-8") as f:
            vocabulary = json.load(f)["model"]["vocab"]
        return cls(sorted({t[1:].lower() for t in vocabulary if len(t) > 3 and not t[0].isascii() and t[1:].isascii() and t[1:].isalpha()}))

    def coverage(self, text: str) -> float:
        """The share of characters in words, the longest word first at each place."""
        low, i, covered = text.lower(), 0, 0
        while i < len(low):
            for n in range(min(self.longest, len(low) - i), 3, -1):
                if low[i : i + n] in self.words:
                    covered += n
                    i += n
                    break
            else:
                i += 1
        return covered / max(1, len(low))

    def surprise(self, text: str) -> float:
        """Mean negative log share of the letter pairs, in nats; 12 for pairs with other characters."""
        low = text.lower()
        pairs = [low[i : i + 2] for i in range(len(low) - 1)]
        if not pairs:
            return 0.0
        return sum(-math.log((self.pairs.get(p, 0) + 0.1) / self.total) if p.isalpha() else 12.0 for p in pairs) / len(pairs)


def candidates(text: str, least: int = 12) -> list[tuple[int, int]]:
    """(start, end) of candidates, by start; of overlapping ones the first."""
    found = []
    for m in _RUN.finditer(text):
        start, end = m.start(), m.end()
        if end - start < least or _DIGIT.search(text, start, end) is None:
            continue
        while end > start and text[end - 1] in ".:=/":
            end -= 1
        if (named := _VALUE.match(text[start:end])) is not None:
            start += named.end()
        if end - start >= least:
            found.append((start, end))
    if "=" in text or ":" in text:
        for m in _NAMED.finditer(text):
            found.append(m.span(1))
    out: list[tuple[int, int]] = []
    for start, end in sorted(found):
        if not out or start >= out[-1][1]:
            out.append((start, end))
    return out


def _kind(c: str) -> int:
    return 0 if c.isdigit() else 1 if c.isupper() else 2 if c.islower() else 3


def features(text: str, start: int, end: int, dictionary: Dictionary) -> list[float]:
    own = text[start:end]
    n = len(own)
    kinds = [_kind(c) for c in own]
    counts = [kinds.count(k) / n for k in range(4)]
    passes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / max(1, n - 1)
    letters = Counter(own)
    entropy = -sum(k / n * math.log2(k / n) for k in letters.values())
    run = longest = 0
    for c in own:
        run = run + 1 if c.isalpha() else 0
        longest = max(longest, run)
    before, after = text[max(0, start - 60) : start], text[end : end + 40]
    near = [w.lower() for w in _WORD.findall(before)[-4:] + _WORD.findall(after)[:2]]
    mark = before.rstrip()[-1:] if before.rstrip()[-1:] not in "\"'" else before.rstrip()[:-1].rstrip()[-1:]
    return [
        float(end - start),
        *counts,
        float(len(set(kinds))),
        passes,
        entropy,
        dictionary.surprise(own),
        dictionary.coverage(own),
        longest / n,
        float(all(c in "0123456789abcdefABCDEF" for c in own)),
        float(own.count("/") + (before[-1:] == "/")),
        float(own.count(".")),
        float("@" in own),
        float("://" in own or before.endswith("://") or "www." in own),
        float(bool(mark) and mark in "=:"),
        float(before[-1:] in "\"'" and bool(before)),
        float(any(w in GOOD_CUES or any(g in w for g in ("password", "secret", "token", "apikey")) for w in near)),
        float(any(w in BAD_CUES for w in near)),
        float(own.startswith(PREFIXES)),
        max(letters.values()) / n,
    ]


class Forest:
    """Random forest for two classes: bootstrap samples, a random subset of features at each split."""

    def __init__(self, trees: int = 40, depth: int = 10, leaf: int = 3, seed: int = 5):
        self.n, self.depth, self.leaf, self.seed = trees, depth, leaf, seed
        self.trees: list[list[tuple]] = []

    def fit(self, x: np.ndarray, y: np.ndarray) -> Forest:
        rng = np.random.default_rng(self.seed)
        for _ in range(self.n):
            rows = rng.integers(0, len(x), len(x))
            nodes: list[tuple] = []
            self._grow(x[rows], y[rows], 0, rng, nodes)
            self.trees.append(nodes)
        return self

    def _grow(self, x: np.ndarray, y: np.ndarray, depth: int, rng, nodes: list[tuple]) -> int:
        place = len(nodes)
        nodes.append((-1, 0.0, float(y.mean()), 0))
        if depth >= self.depth or len(y) < 2 * self.leaf or y.min() == y.max():
            return place
        best = None
        for f in rng.permutation(x.shape[1])[: max(1, round(math.sqrt(x.shape[1])))]:
            order = np.argsort(x[:, f], kind="stable")
            v, c = x[order, f], np.cumsum(y[order])
            cut = np.flatnonzero(v[1:] > v[:-1]) + 1
            cut = cut[(cut >= self.leaf) & (cut <= len(y) - self.leaf)]
            if not len(cut):
                continue
            left, right = c[cut - 1], c[-1] - c[cut - 1]
            impurity = left * (cut - left) / cut + right * (len(y) - cut - right) / (len(y) - cut)
            i = int(impurity.argmin())
            if best is None or impurity[i] < best[0]:
                best = (float(impurity[i]), int(f), float((v[cut[i] - 1] + v[cut[i]]) / 2))
        if best is None:
            return place
        _, f, at = best
        side = x[:, f] <= at
        self._grow(x[side], y[side], depth + 1, rng, nodes)  # the left child is the next node
        nodes[place] = (f, at, 0.0, self._grow(x[~side], y[~side], depth + 1, rng, nodes))
        return place

    def score(self, row: list[float]) -> float:
        total = 0.0
        for nodes in self.trees:
            at = 0
            while (node := nodes[at])[0] >= 0:
                at = at + 1 if row[node[0]] <= node[1] else node[3]
            total += node[2]
        return total / len(self.trees)


def labelled_findings(count: int = 4000, seed: int = 3) -> list[tuple[str, int, int, int]]:
    """(text, start, end, label) of made-up findings, half of them secrets, for want of a table of
    real ones; the tables at hand label none."""
    r = random.Random(seed)
    alnum = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
    pick = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    syllables = ["th", "er", "on", "an", "re", "he", "in", "ed", "nd", "ha", "at", "en", "es", "of", "or", "ti", "la", "de", "que", "ung", "sch"]
    word = lambda: "".join(r.choice(syllables) for _ in range(r.randint(1, 4)))
    words = lambda a, b: " ".join(word() for _ in range(r.randint(a, b)))
    names = ["password", "passwd", "secret", "token", "api_key", "apikey", "access_key", "auth_token", "client_secret", "DB_PASSWORD", "TOKEN", "SECRET_KEY"]
    hexa = "0123456789abcdef"
    out = []
    for i in range(count):
        if secret := i % 2 == 0:
            value, before = r.choice(
                [
                    lambda: ("AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16), ""),
                    lambda: ("AKIA" + pick("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", 16), r.choice(["", "key ", "aws_access_key_id = "])),
                    lambda: (r.choice(["ghp_", "gho_"]) + pick(alnum, 36), ""),
                    lambda: (r.choice(["sk-", "sk_live_"]) + pick(alnum, r.randint(24, 48)), ""),
                    lambda: (pick(hexa, r.choice([16, 18, 20, 24, 32, 40, 64])), r.choice(names) + r.choice(["=", " = ", ": ", '="', ' = "'])),
                    lambda: (pick(alnum + "+/", r.randint(20, 64)), r.choice(names) + r.choice(["=", " = ", ": ", ' = "'])),
                    lambda: (pick(alnum + "!#%", r.randint(8, 16)) + "7", r.choice(names) + r.choice(["=", ": "])),
                    lambda: ("xoxb-" + pick("0123456789", 12) + "-" + pick(alnum, 24), ""),
                    lambda: (pick(alnum, r.randint(32, 64)), "Bearer "),
                ]
            )()
        else:
            value, before = r.choice(
                [
                    lambda: (pick(hexa, 40), r.choice(["commit ", "sha1 ", "checksum: ", "hash "])),
                    lambda: (pick(hexa, r.choice([32, 64])), r.choice(["md5 ", "sha256: ", "digest ", "checksum "])),
                    lambda: ("-".join(pick(hexa, n) for n in (8, 4, 4, 4, 12)), r.choice(["uuid ", "id ", ""])),
                    lambda: ("/" + "/".join(word() for _ in range(4)) + str(r.randint(1, 99)) + ".txt", r.choice(["file ", "path ", ""])),
                    lambda: (f"https://www.{word()}.com/{word()}/{r.randint(1, 9999)}/{word()}", ""),
                    lambda: (f"{pick('abcdefghiklmnoprst', r.randint(3, 9))}.{r.randint(0, 99):02d}@mail{r.randint(0, 9)}.example.com", ""),
                    lambda: (pick("0123456789", r.choice([13, 16, 19])), r.choice(["", "card ", "isbn "])),
                    lambda: (".".join(str(r.randint(0, 255)) for _ in range(4)), ""),
                    lambda: (f"{word()}-{word()}-{r.randint(1, 99)}.{r.randint(0, 9)}.{r.randint(0, 9)}", "version "),
                    lambda: (f"{word()}{word()}{word()}{r.randint(1, 99)}", ""),
                    lambda: (r.choice(["your_api_key_here1", "xxxxxxxxxxxx1234", "changeme12345", "example_password1", "000000000000"]), r.choice(names) + "="),
                    lambda: ("=" * r.randint(3, 9) + str(r.randint(1, 99)) + "-" * 12, ""),
                    lambda: (f"{r.randint(1990, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}T{r.randint(0, 23):02d}:{r.randint(0, 59):02d}:00", ""),
                    lambda: (word() + "_" + word() + "_" + word() + str(r.randint(1, 9)), ""),
                ]
            )()
        head = words(0, 5) + " " + before
        closing = '"' if before.endswith('"') else ""
        out.append((head + value + closing + r.choice([" ", ". ", "\n"]) + words(0, 4), len(head), len(head) + len(value), int(secret)))
    return out


def train(findings: list[tuple[str, int, int, int]], dictionary: Dictionary, limit: int = 20_000, **options) -> Forest:
    """A forest from at most ``limit`` labelled findings (text, start, end, 0 or 1)."""
    use = [f for f in findings if f[0] and f[3] in (0, 1) and f[1] < f[2]][:limit]
    x = np.array([features(t, a, b, dictionary) for t, a, b, _ in use])
    return Forest(**options).fit(x, np.array([f[3] for f in use], dtype=np.float64))


def scan_documents(docs: DataFrame, forest: Forest, dictionary: Dictionary, threshold: float = 0.5) -> DataFrame:
    """A row per row of ``docs`` (doc_id, text): doc_id, n_candidates, and secrets, an array of
    (start, end, score) in code points, the end exclusive.

    Null and empty texts have none.  Texts are read whole.  Repeated rows get equal results.  An
    empty table gives an empty result.  Other columns, of any name, are not read.
    """
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, found = [], []
            for text in batch.column(1).to_pylist():
                spans = candidates(text or "")
                scored = [(a, b, forest.score(features(text, a, b, dictionary))) for a, b in spans]
                n.append(len(spans))
                found.append([{"start": a, "end": b, "score": s} for a, b, s in scored if s >= threshold])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(found, kind)], names=["doc_id", "n_candidates", "secrets"])

    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(scan, "doc_id long, n_candidates long, secrets array<struct<start:long,end:long,score:double>>")
