"""Operator 9, toxicity: noisy-channel deobfuscation under a character language model, then scoring of the restored text."""

from __future__ import annotations

import functools
import hashlib
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import chunks, mixed, narrow, positional, remove, utf8, written
from .minhash import shingle_sets
from .tokens import LETTER, classes
from .words import Words

#: The most labelled documents that the classifier is fitted on, chosen by a hash of doc_id.
TRAINED = 20_000
#: Prefix lengths that are features beside whole words.
PREFIXES = (4, 5, 6, 7, 8)
#: Distinct tokens whose evidence a worker keeps from one task to the next, and their longest (bytes): about 30 MB.
CACHED_TOKENS, CACHED_LENGTH = 150_000, 48


@dataclass(frozen=True)
class Settings:
    """What counts as evidence; chosen by cross_validated() within the rows that may be learned from."""

    #: The share of false findings allowed among all features that are tested.
    false_findings: float = 0.05
    #: The least purity, at the lower end of a 95 % interval, of a feature that counts as evidence.
    purity: float = 0.5
    #: The purity with which a feature that at least the share ``common`` of toxic documents has is evidence, whatever other
    #: features they have.
    nearly_pure: float = 0.9
    common: float = 0.1
    #: Fewer documents with a feature are no evidence.
    least: int = 4


# The letters of the language model (0 is a word's edge, 1 any other character), leetspeak, channel costs.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöøùúûüýßœ"
LEET = {"0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b", "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l", "¡": "i", "*": "aeiou"}
SEPARATORS = "._-~'`·/\\* "
COSTS = {"leet": 1.0, "separator": 0.5, "repeat": 0.8, "stay": 3.0}
SIZE = 64
CODE = {c: k + 2 for k, c in enumerate(LETTERS)}

#: Signs before a word, and those after it, last first; a single ! or * may be a letter if an underscore follows.
HEAD = re.compile(r"[\s\"'(\[{<,;:.?¿&%#*=~`^_/\\>-]*+")
TAIL = re.compile(r"(?:[\s\"')\]}>,;:.?%#&=~`^/\\-]|[!$*+|]{2,}+|[!*])*+(?:[\s\"')\]}>,;:.?%#&=~`^_/\\-]|[!$*+|]{2,}+)*+")
#: An e-mail address under a usual top-level domain, or a URL.
ADDRESS = re.compile(r"(?:mailto:)?[^\W_][\w.%+-]*+@(?:[^\W_](?:[^\W_]|-)*+\.)+(?:[a-z]{2}|com|org|net|edu|gov|mil|int|info|biz|name|test|example|invalid)|(?:https?|ftps?|wss?|git|ssh)://(?:[\w.%+:-]+@)?[\w-]+(?:\.[\w-]+)*+(?::\d+)?(?:[/?#].*)?", re.S)
REPEATED = re.compile(r"([^\W\d_])\1\1")
SPACED = re.compile(r"(?:^|[\W_])[^\W\d_](?:[._\-~'`·/\\*][^\W\d_]){2,}(?:$|[\W_])")
SPELLED = re.compile(r"(?<![^\s._\-~'`·/\\])[^\s._\-~'`·/\\](?:[._\-~'`·/\\* ][^\s._\-~'`·/\\]){2,}(?![^\s._\-~'`·/\\])")
BETWEEN = re.compile(r"[._\-~'`·/\\ ]+")
JOINED = str.maketrans("", "", SEPARATORS)
PLAIN = re.compile(r"[^\W\d_]+")


@functools.cache
def _letter_codes() -> np.ndarray:
    table = (classes() == LETTER).astype(np.uint8)
    for c, k in CODE.items():
        table[ord(c)] = k
    return table


class CharModel:
    """Trigram costs (negative logarithms) of letters within words, smoothed by shorter contexts; travels as one array."""

    def __init__(self, counts: np.ndarray):
        three = counts.reshape(SIZE, SIZE, SIZE).astype(float)
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one + 0.5) / (one + 0.5).sum()
        p2 = (two + 2 * p1) / (two.sum(1, keepdims=True) + 2)
        p3 = (three + 2 * p2) / (three.sum(2, keepdims=True) + 2)
        self.costs = -np.log(p3)

    def __getstate__(self) -> dict:
        return {"costs": self.costs}

    @functools.cached_property
    def cost(self) -> list[list[list[float]]]:
        """The costs as nested lists, which plain Python reads fastest."""
        return self.costs.tolist()


def trigram_counts(docs: DataFrame) -> DataFrame:
    """(code, n): how often each trigram of letters occurs in the words of all texts, summed up before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = _letter_codes()
        for part in chunks(batches, 0):
            data, _ = utf8(part.column(0))
            code = table[np.frombuffer(f"  {data.tobytes().decode().lower()}  ".encode("utf-32-le"), np.uint32)].astype(np.int64)
            three = (code[:-2] * SIZE + code[1:-1]) * SIZE + code[2:]
            three = three[(code[1:-1] > 0) | ((code[2:] > 0) & (code[1:-1] == 0))]
            three = np.where((three // SIZE) % SIZE == 0, three % SIZE, three)  # a word's first letter: nothing before its edge counts
            found, n = np.unique(three, return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(n)], ["code", "n"])

    return docs.mapInArrow(run, "code bigint, n bigint").groupBy("code").agg(F.sum("n").alias("n"))


def fit_language_model(docs: DataFrame) -> CharModel:
    """Counts all texts; at most SIZE**3 sums reach the driver."""
    counts = np.zeros(SIZE**3, np.int64)
    for r in trigram_counts(narrow(docs, "text")).collect():
        counts[r["code"]] = r["n"]
    return CharModel(counts)


def restore(token: str, model: CharModel, spelled: bool = False) -> str:
    """The most likely plain words behind a token: Viterbi over a lattice in which a character stays, is the letter that a
    digit or sign stands for, or is left out as a separator or as a repetition of the letter before it. In a
    token spelled out letter by letter no separator or leetspeak stays. Time is linear in the token's length."""
    states: dict[tuple[int, int], tuple[float, tuple | None]] = {(0, 0): (0.0, None)}  # the letters so far are linked, last first
    cost = model.cost
    for c in token:
        after: dict[tuple[int, int], tuple[float, tuple | None]] = {}

        def offer(key: tuple[int, int], price: float, text: tuple | None) -> None:
            if key not in after or price < after[key][0]:
                after[key] = (price, text)

        for (a, b), (so_far, text) in states.items():
            if c.isalpha():
                k = CODE.get(c, 1)
                offer((b, k), so_far + cost[a][b][k], (c, text))
                if text and text[0] == c:
                    offer((a, b), so_far + COSTS["repeat"], text)
            else:
                for x in LEET.get(c, ""):
                    k = CODE[x]
                    offer((b, k), so_far + COSTS["leet"] + cost[a][b][k], (x, text))
                    if text and text[0] == x:
                        offer((a, b), so_far + COSTS["leet"] + COSTS["repeat"], text)
                if c in SEPARATORS:
                    offer((a, b), so_far + COSTS["separator"], text)
                if (c not in LEET or c.isdigit()) and not (spelled and (c in LEET or c in SEPARATORS)):
                    offer((0, 0), so_far + COSTS["stay"] + cost[a][b][0], (c, text))
        states = after
    text, out = min(((price + cost[a][b][0], text) for (a, b), (price, text) in states.items()), key=lambda s: s[0])[1], []
    while text:
        out.append(text[0])
        text = text[1]
    return "".join(reversed(out))


def readings(token: str, model: CharModel) -> tuple[list[str], list[str]]:
    """The words of a token without white space, or of single characters with a space between each, restored where it
    looks disguised, as a whole and between its separators; and the letters of what is spelled out one by one, in which one
    word follows another."""
    low = token.lower()
    if low.isalpha() and not REPEATED.search(low):
        return [low], []
    core = low[HEAD.match(low).end() :][::-1]
    core = core[TAIL.match(core).end() :][::-1]
    if not ADDRESS.fullmatch(core):
        letters = sum(c.isalpha() for c in core)
        leet = any(c in LEET for c in core)
        if letters >= 2 and (leet or " " in core or REPEATED.search(core)) or SPACED.search(core):
            spelled = [*PLAIN.findall(restore(core, model, True)), *PLAIN.findall(core.translate(JOINED))] if SPELLED.search(core) else []
            parts = BETWEEN.split(core) if not spelled else []
            own = [restore(x, model) for x in parts if sum(c.isalpha() for c in x) >= 2 and (any(c in LEET for c in x) or REPEATED.search(x))] if len(parts) > 1 else []
            return [w for x in (restore(core, model), core, *own) for w in PLAIN.findall(x)], spelled
    return PLAIN.findall(low), []


def plain_words(token: str, model: CharModel) -> list[str]:
    return readings(token, model)[0]


def features_of(word: str) -> list[str]:
    """A word and its prefixes; words of one or two letters have none."""
    return [f"={word}", *[f"{word[:k]}-" for k in PREFIXES if len(word) >= k]] if len(word) > 2 else []


@dataclass
class Texts:
    """The tokens of many texts, and the runs of single letters in them joined to words."""

    data: np.ndarray
    offsets: np.ndarray
    spaced: list[tuple[int, str]] = field(default_factory=list)

    def __post_init__(self) -> None:
        self.words = w = Words(self.data, self.offsets)
        self.tokens = [t.decode("utf-8", "replace") for t in w.values.dictionary.to_pylist()]
        single = np.array([len(t) == 1 and t.isalnum() or t in LEET for t in self.tokens], bool)[w.ids] if len(w.ids) else np.zeros(0, bool)
        edge = np.append(w.doc[1:] != w.doc[:-1], True) if len(w.ids) else single
        starts = np.flatnonzero(single & ~np.concatenate([[False], single[:-1] & ~edge[:-1]]))
        for s in starts.tolist():
            e = s
            while not edge[e] and single[e + 1]:
                e += 1
            if e - s >= 2:
                self.spaced.append((int(w.doc[s]), " ".join(self.tokens[i] for i in w.ids[s : e + 1])))


#: The telling words of tokens that this worker has met, for the model it used last, by the model's digest.
_MET: tuple[bytes, dict[str, dict[str, float] | None]] = (b"", {})


@dataclass
class ToxicityModel:
    language: CharModel
    #: The least probability (95 %) that a document with the feature is toxic; the features are words and their prefixes.
    evidence: dict[str, float]
    #: The probability for documents without any.
    base: float

    @functools.cached_property
    def digest(self) -> bytes:
        return hashlib.blake2b(repr(sorted(self.evidence.items())).encode() + self.language.costs.tobytes(), digest_size=16).digest()

    def met(self) -> dict[str, dict[str, float] | None]:
        """The telling words of tokens met before, in this task or an earlier one of the worker; None for most, which have none."""
        global _MET
        if _MET[0] != self.digest or len(_MET[1]) > CACHED_TOKENS:
            _MET = (self.digest, {})
        return _MET[1]

    def words_in(self, token: str) -> dict[str, float]:
        """The telling words of a token: the strongest evidence of each."""
        out = {}
        words, spelled = readings(token, self.language)
        for w in words if not spelled else ():
            best = max((self.evidence.get(f, 0.0) for f in features_of(w)), default=0.0)
            if best:
                out[w] = best
        lengths = sorted({len(f) - 1 for f in self.evidence}) if spelled else []
        for w in spelled:  # where a word ends is not known: the evidence at every start
            for s in range(len(w)):
                found = [(k, e) for k in lengths if s + k <= len(w) and (e := max(self.evidence.get(f"={w[s : s + k]}", 0.0), self.evidence.get(f"{w[s : s + k]}-", 0.0)))]
                if found:
                    out[w[s : s + found[-1][0]]] = max(e for _, e in found)
        return out

    def features(self, data: np.ndarray, offsets: np.ndarray) -> list[set[str]]:
        """The evidence, by feature, that each text has."""
        return [{g for w in f for g in features_of(w) if g in self.evidence} for f in self.telling(data, offsets)]

    def scores(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """A noisy or over the distinct telling words of each text."""
        return np.array([1 - (1 - self.base) * math.prod(1 - p for p in f.values()) for f in self.telling(data, offsets)])

    def telling(self, data: np.ndarray, offsets: np.ndarray) -> list[dict[str, float]]:
        """The telling words of each text with their evidence."""
        texts = Texts(data, offsets)
        found: list[dict[str, float]] = [{} for _ in range(len(offsets) - 1)]
        met, telling = self.met(), {}
        for k, t in enumerate(texts.tokens):
            own = met.get(t, self)
            if own is self:
                own = self.words_in(t) or None
                if len(t) <= CACHED_LENGTH:
                    met[t] = own
            if own is not None:
                telling[k] = own
        if telling:
            for k in np.flatnonzero(np.isin(texts.words.ids, [*telling])):
                found[texts.words.doc[k]].update(telling[int(texts.words.ids[k])])
        for d, word in texts.spaced:
            found[d].update(self.words_in(word))
        return found


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _training(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int) -> DataFrame:
    """(f1, f2, toxic, text) of labelled documents that may be learned from, one for each set of shingles."""
    own = narrow(labels, "doc_id", "toxic").filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    own = own.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    both = narrow(docs, "doc_id", "text").join(F.broadcast(own), "doc_id").select("doc_id", F.col("toxic").cast("int"), "text")  # at most ``most`` pairs of numbers

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 2):
            h, counts = shingle_sets(*utf8(part.column(2)), 3)
            f = np.zeros((2, len(counts)), np.uint64)
            full = np.flatnonzero(counts)
            if len(full):
                first = (np.cumsum(counts) - counts)[full]
                f[0, full], f[1, full] = np.add.reduceat(mixed(h), first), np.add.reduceat(mixed(~h), first)
            yield pa.RecordBatch.from_arrays([pa.array(f[0].view(np.int64)), pa.array(f[1].view(np.int64)), *part.columns], ["f1", "f2", "doc_id", "toxic", "text"])

    table = written(spark, both.mapInArrow(run, f"f1 bigint, f2 bigint, doc_id {both.schema['doc_id'].dataType.simpleString()}, toxic int, text string"), "labelled")
    return table.groupBy("f1", "f2", "toxic").agg(F.min_by("text", "doc_id").alias("text"))


def likenesses(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Four keys for each text, of two minimum shingle hashes each: near copies nearly always share one. A text without
    words has keys of its own place."""
    h, counts = shingle_sets(data, offsets, 3)
    out = mixed(np.arange(4 * len(counts), dtype=np.uint64) ^ np.uint64(len(data) + 1)).reshape(-1, 4)
    full = np.flatnonzero(counts)
    if len(full):
        first = (np.cumsum(counts) - counts)[full]
        least = [np.minimum.reduceat(mixed(h ^ np.uint64(k << 56)), first) for k in range(8)]
        for k in range(4):
            out[full, k] = mixed(least[2 * k] ^ mixed(least[2 * k + 1]))
    return out.view(np.int64)


def grouped(alike: list[list[int]]) -> list[int]:
    """For each row the first row that it is tied to by shared keys."""
    up, first = list(range(len(alike))), {}

    def top(x: int) -> int:
        while up[x] != x:
            up[x] = x = up[up[x]]
        return x

    for k, keys in enumerate(alike):
        for key in keys:
            a, b = top(first.setdefault(key, k)), top(k)
            up[max(a, b)] = min(a, b)
    return [top(k) for k in range(len(alike))]


def log_tail(k: int, n: int, p: float) -> float:
    """An upper bound (Chernoff) on the logarithm of the chance of k or more in n draws of probability p."""
    q = k / n
    if q <= p:
        return 0.0
    return -n * (q * math.log(q / p) + ((1 - q) * math.log((1 - q) / (1 - p)) if q < 1 else 0.0))


def least_share(k: int, n: int) -> float:
    """The lower end of Wilson's 95 % interval for a share of k in n."""
    q, z = k / n, 1.96
    return (q + z * z / (2 * n) - z * math.sqrt(q * (1 - q) / n + z * z / (4 * n * n))) / (1 + z * z / n)


def explaining(candidates: dict[str, float], docs_of: dict[str, set[int]], bad: set[int], settings: Settings) -> dict[str, float]:
    """The candidates that are evidence by themselves: common, nearly pure ones, and others, purest first, if they are still
    evidence among the documents that those before them do not explain. A rare word of a few toxic documents that
    have a telling word anyway is none."""
    out, explained = {}, set()
    for f, low in sorted(candidates.items(), key=lambda x: (-x[1], -len(docs_of[x[0]]), x[0])):
        rest = docs_of[f] - explained
        if low >= settings.nearly_pure and len(docs_of[f] & bad) >= settings.common * len(bad) or len(rest) >= settings.least and least_share(len(rest & bad), len(rest)) >= settings.purity:
            out[f] = low
            explained |= docs_of[f]
    return out


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, most: int = TRAINED, settings: Settings = Settings()) -> ToxicityModel:
    """Learns the language model from all texts and the evidence from a bounded sample of labelled ones.

    A feature (a restored word or its prefix) is evidence if toxic documents have it more often than chance allows for
    any of the features tested, and if all but few documents with it are toxic. Texts of the same shingles count once, and
    documents that resemble each other are one witness, toxic if most of them are: near copies share rare words by
    descent, not because these tell anything. Features are counted in parts and summed up; only those that pass, and which
    of them each document of the sample has, reach the driver, which picks those that explain the labels.
    """
    language = fit_language_model(docs)
    labelled = _training(spark, docs, labels, most)
    train = written(spark, labelled, "training")
    remove(spark, labelled)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 1):
            texts = Texts(*utf8(part.column(1)))
            toxic = np.array(part.column(0).to_pylist(), bool)
            w = texts.words
            order = np.lexsort((w.doc, w.ids))
            token, doc = w.ids[order], w.doc[order]
            first = np.append(True, (token[1:] != token[:-1]) | (doc[1:] != doc[:-1]))[: len(token)]
            token, doc = token[first], doc[first]
            cuts = np.searchsorted(token, np.arange(len(texts.tokens) + 1))
            number: dict[str, int] = {}
            which, docs_with = [], []
            for t, docs_of_t in [*((t, doc[cuts[k] : cuts[k + 1]]) for k, t in enumerate(texts.tokens)), *((t, np.array([d])) for d, t in texts.spaced)]:
                for f in {f for x in plain_words(t, language) for f in features_of(x)}:
                    which.append(number.setdefault(f, len(number)))
                    docs_with.append(docs_of_t)
            sizes = np.fromiter(map(len, docs_with), np.int64, len(docs_with))
            pair = np.unique(np.repeat(np.array(which, np.int64), sizes) * len(toxic) + np.concatenate([np.zeros(0, np.int64), *docs_with]))
            feature, bad = pair // len(toxic), toxic[pair % len(toxic)]
            yield pa.RecordBatch.from_arrays([pa.array([*number], pa.string()), pa.array(np.bincount(feature, minlength=len(number))), pa.array(np.bincount(feature[bad], minlength=len(number)))], ["feature", "n", "bad"])

    counts = written(spark, train.select("toxic", "text").mapInArrow(run, "feature string, n bigint, bad bigint").groupBy("feature").agg(F.sum("n").alias("n"), F.sum("bad").alias("bad")), "features")
    size = train.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    rate = (size["bad"] + 0.5) / (size["n"] + 1)
    tested = max(1, counts.filter(F.col("n") >= settings.least).count())
    candidates = {}
    for r in counts.filter((F.col("n") >= settings.least) & (F.col("bad") > settings.purity * F.col("n"))).collect():
        low = least_share(r["bad"], r["n"])
        if low >= settings.purity and log_tail(r["bad"], r["n"], rate) < math.log(settings.false_findings / tested):
            candidates[r["feature"]] = low

    def held(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = ToxicityModel(language, candidates, 0.0)
        for part in chunks(batches, 1):
            data, offsets = utf8(part.column(1))
            toxic, alike = part.column(0).to_pylist(), likenesses(data, offsets)
            for bad, found, own in zip(toxic, finder.features(data, offsets), alike.tolist()):
                if found:
                    yield pa.RecordBatch.from_arrays([pa.array([bad], pa.int32()), pa.array([sorted(found)], pa.list_(pa.string())), pa.array([own], pa.list_(pa.int64()))], ["toxic", "found", "alike"])

    rows = train.select("toxic", "text").mapInArrow(held, "toxic int, found array<string>, alike array<bigint>").collect()  # at most ``most`` rows
    group = grouped([r["alike"] for r in rows])
    docs_of: dict[str, set[int]] = {f: set() for f in candidates}
    votes: dict[int, int] = {}
    for g, r in zip(group, rows):
        votes[g] = votes.get(g, 0) + (1 if r["toxic"] else -1)
        for f in r["found"]:
            docs_of[f].add(g)
    bad = {g for g, v in votes.items() if v > 0}
    low = {f: least_share(len(own & bad), len(own)) for f, own in docs_of.items() if len(own) >= settings.least}
    candidates = {f: x for f, x in low.items() if x >= settings.purity and log_tail(len(docs_of[f] & bad), len(docs_of[f]), rate) < math.log(settings.false_findings / tested)}
    for table in (train, counts):
        remove(spark, table)
    return ToxicityModel(language, explaining(candidates, docs_of, bad, settings), 0.5 * rate)


def score(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score and predicted of each row (doc_id, text); no shuffle.

    A null or empty text has the score of a text without evidence; tokens of any length are decoded, texts of any length
    read whole; held_out is false where doc_id is null; repeated rows each get their row; an empty table gives an empty
    result; further columns, whatever their names, are ignored.
    """
    src = narrow(docs, "doc_id", "text").select("doc_id", held_out().alias("held_out"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, 2):
            s = model.scores(*utf8(part.column(2)))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(s, pa.float64()), pa.array((s >= threshold).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return src.mapInArrow(run, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, held_out boolean, score double, predicted int")


def cross_validated(spark: SparkSession, docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), folds: int = 3, threshold: float = 0.7) -> dict[str, float]:
    """The shares of toxic and of clean documents that are predicted to be toxic, by models of the other folds, over the
    labelled rows that may be learned from; rows held out are not looked at."""
    own = narrow(labels, "doc_id", "toxic").filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).withColumn("fold", F.pmod(F.xxhash64("doc_id", F.lit("fold")), F.lit(folds)))
    hit, n = [0, 0], [0, 0]
    for k in range(folds):
        mine = own.filter(F.col("fold") == k).groupBy("doc_id").agg(F.max("toxic").alias("toxic"))
        model = fit(spark, docs, own.filter(F.col("fold") != k), settings=settings)
        tested = narrow(docs, "doc_id", "text").join(mine.select("doc_id"), "doc_id", "left_semi")
        for r in score(tested, model, threshold).join(mine, "doc_id").groupBy("toxic").agg(F.sum("predicted").alias("hit"), F.count("*").alias("n")).collect():
            hit[r["toxic"]] += r["hit"]
            n[r["toxic"]] += r["n"]
    return {"caught": hit[1] / max(1, n[1]), "flagged": hit[0] / max(1, n[0])}


def keep_civil(docs: DataFrame, model: ToxicityModel, threshold: float = 0.7) -> DataFrame:
    """The rows of ``docs`` that score() does not predict to be toxic, all columns unchanged; no shuffle.

    A null or empty text is kept unless most documents are toxic; ids may be null or repeat, each row is judged by its own
    text, however long; an empty table gives an empty one; further columns, also such as differ only by case, stay.
    """
    place, plain = docs.columns.index("text"), positional(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in chunks(batches, place):
            yield part.filter(pa.array(model.scores(*utf8(part.column(place))) < threshold))

    return plain.mapInArrow(run, plain.schema).toDF(*docs.columns)
