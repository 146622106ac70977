"""Toxicity by a weighted lexicon, matched with an Aho-Corasick automaton.

Words are folded (case, look-alike letters of other scripts, digits and signs put for
letters), the lexicon's patterns are matched in one pass over the folded text, matches
inside exception phrases don't count, and the evidence is normalised by length.

The lexicon is learned: its patterns are words and word beginnings whose share among toxic
labelled texts is surely above that among the others; its exceptions are longer
beginnings that lean the other way. Near copies among the labelled texts count once.
Learning uses a bounded sample of labelled rows, ``SAMPLE`` at most in expectation, half
of each label where there are enough; the sample bounds the patterns and exceptions, all
that pass are kept. Scoring covers every whole text.
"""

from __future__ import annotations

import math
import unicodedata
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, fresh, map_batches, written
from .digest import add_columns

#: Labelled rows to learn from, shortest and longest beginning of a word.
SAMPLE, SHORTEST, LONGEST = 20_000, 3, 8
#: A pattern's log odds must exceed PURE, and less SURE standard errors still MARGIN.
PURE, SURE, MARGIN = 2.2, 2.6, 0.7
#: A beginning goes if one longer one is in this share of its toxic texts.
SAME = 0.9
#: Features whose counts a task holds before it passes them on, and folded words it keeps.
HELD = 100_000

#: Letters that look like Latin ones, and what is put for letters.
LOOKALIKES = str.maketrans("аеорсухіѕјһԁӏкмтвнαορνκτιυɑɡοℓ", "aeopcyxisjhdlkmtbhaopvktiuagol")
SUBSTITUTES = str.maketrans("0134578@$!|+", "oieastbasiit")
#: Harmless phrases that contain words which are often meant badly.
EXCEPTIONS = ("trash can", "trash bag", "trash bin", "pond scum", "clown fish", "class clown")


def fold_word(word: str) -> str:
    """A word's folded form: letters and digits, parts separated by single spaces."""
    w = unicodedata.normalize("NFKC", word).lower().translate(LOOKALIKES)
    if not w.isalpha():
        core = w.strip(".,;:!?\"'()[]{}<>«»„“”…-–—*#%&$@|+=~_/\\^`")
        if any(c.isalpha() for c in core) and not core.isalpha():
            core = core.translate(SUBSTITUTES)
        w = " ".join("".join(c if c.isalnum() else " " for c in core).split())
    return w


class Folder:
    def __init__(self):
        self.met: dict[str, str] = {}

    def __call__(self, text: str | None) -> str:
        """The folded text between single spaces; a text without letters and digits is one space."""
        words = (text or "").split()
        try:
            folded = [self.met[w] for w in words]
        except KeyError:
            new = {w for w in set(words) if w not in self.met}
            if len(self.met) + len(new) > HELD:
                self.met, new = {}, set(words)
            self.met.update((w, fold_word(w)) for w in new)
            folded = [self.met[w] for w in words]
        return " " + " ".join([w for w in folded if w]) + " " if words else " "


def beginnings(folded: str) -> set[str]:
    """Features of a folded text: its words between spaces, and their beginnings after a space."""
    out = set()
    for w in set(folded.split()):
        out.add(f" {w} ")
        out.update(f" {w[:k]}" for k in range(SHORTEST, min(LONGEST, len(w)) + 1))
    return out


def signature(folded: str) -> int:
    """Equal for copies and most near copies: the least hash of the text's 3-word runs."""
    w = folded.split()
    return min((zlib.crc32(" ".join(w[i : i + 3]).encode()) for i in range(max(1, len(w) - 2))), default=0)


def log_odds(toxic: float, clean: float, n_toxic: float, n_clean: float) -> tuple[float, float]:
    """Of a feature's shares, and what is surely exceeded."""
    value = math.log((toxic + 0.5) / (n_toxic + 1)) - math.log((clean + 0.5) / (n_clean + 1))
    return value, value - SURE * math.sqrt(1 / (toxic + 0.5) + 1 / (clean + 0.5))


def without_shorter(features: list) -> list:
    """Beginnings of words whose toxic texts nearly all come from one longer beginning are left out: the longer one says the same and hits less else."""
    toxic = {r["feature"]: r["t0"] + r["t1"] for r in features if not r["feature"].endswith(" ")}
    longer: dict[str, int] = {}
    for f, t in toxic.items():
        for k in range(1 + SHORTEST, len(f)):
            longer[f[:k]] = max(longer.get(f[:k], 0), t)
    return [r for r in features if r["feature"].endswith(" ") or longer.get(r["feature"], 0) < SAME * toxic[r["feature"]]]


class Lexicon:
    """Weighted patterns and exceptions; ``coefficients`` turn evidence into a score."""

    def __init__(self, weights: dict[str, float], exceptions: tuple[str, ...] = (), coefficients: tuple[float, ...] = (0.0, 0.0, 0.0)):
        self.weights, self.exceptions, self.coefficients = weights, exceptions, coefficients
        self.automaton = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"automaton": None}

    def _build(self):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for p in self.exceptions:
            self.automaton.add_word(p, (len(p), 0.0))
        for p, w in self.weights.items():
            self.automaton.add_word(p, (len(p), w))
        if len(self.automaton):
            self.automaton.make_automaton()
        return self.automaton

    def evidence(self, folded: str) -> tuple[float, float]:
        """The weights of what matches outside exceptions, and the same for each 100 words.

        At each place the strongest pattern counts; n matches of a pattern count ``1 + ln(n)`` times.
        """
        automaton = self.automaton if self.automaton is not None else self._build()
        if not len(automaton):
            return 0.0, 0.0
        hits: dict[int, tuple[float, int]] = {}
        free: list[tuple[int, int]] = []
        for end, (length, weight) in automaton.iter(folded):
            start = end - length + 1
            if weight:
                hits[start] = max(hits.get(start, (0.0, 0)), (weight, length))
            else:
                free.append((start, end))
        for a, z in free:
            for at in [h for h in hits if a <= h < z]:
                del hits[at]
        found: dict[str, list[float]] = {}
        for at, (weight, length) in hits.items():
            found.setdefault(folded[at : at + length].rstrip(), []).append(weight)
        total = sum(max(w) * (1 + math.log(len(w))) for w in found.values())
        return total, 100 * total / max(1, folded.count(" ") - 1)

    def score(self, folded: str) -> float:
        total, dense = self.evidence(folded)
        a, b, c = self.coefficients
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, a + b * math.log1p(total) + c * math.log1p(dense)))))


def fit_scores(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 1e-2) -> np.ndarray:
    """Logistic regression by Newton steps; coefficients of evidence aren't negative."""
    x = np.column_stack([np.ones(len(x)), x])
    beta = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -30, 30)))
        grad = x.T @ (y - p) - ridge * beta
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge * np.eye(len(beta)), grad)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-6:
            break
    return beta if (beta[1:] >= 0).all() else _only_first(x, y, beta)


def _only_first(x: np.ndarray, y: np.ndarray, beta: np.ndarray) -> np.ndarray:
    k = 1 + int(np.argmax(beta[1:]))
    if x.shape[1] == 2:
        return np.array([beta[0], max(0.0, beta[1])])
    small = fit_scores(x[:, [k]], y)
    out = np.zeros(x.shape[1])
    out[0], out[k] = small
    return out


def held_out(doc_id: str = "doc_id"):
    """True for the fold that is never learned from; null ids belong to it."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(True))


def learn_lexicon(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", toxic: str = "toxic", sample: int = SAMPLE, exceptions: tuple[str, ...] = EXCEPTIONS) -> Lexicon:
    """A lexicon from the labelled rows that aren't held out.

    Rows without a label of 0 or 1 are left out; several labels of one id count as toxic if
    one does. Of several rows with one id, one is learned from, always the same, and of near
    copies the one whose folded text comes first. Without a labelled row of either kind the lexicon is empty and every score
    is 0.5 or, if one kind is known, its certainty.
    """
    known = labels.where(F.col(toxic).isin(0, 1) & ~held_out(doc_id)).groupBy(F.col(doc_id).alias("_id")).agg(F.max(toxic).alias("_toxic"))
    n = {int(r["_toxic"]): r["count"] for r in known.groupBy("_toxic").count().collect()}
    share = F.when(F.col("_toxic") == 1, min(1.0, sample / 2 / max(1, n.get(1, 0)))).otherwise(min(1.0, sample / 2 / max(1, n.get(0, 0))))
    chosen = known.where(F.pmod(F.xxhash64(F.lit("sample"), "_id"), F.lit(1 << 20)) < share * (1 << 20))
    found = docs.join(F.broadcast(chosen), docs[doc_id] == F.col("_id")).select("_id", "_toxic", F.struct(F.xxhash64(text), F.coalesce(F.col(text), F.lit("")).alias("text")).alias("x"))
    # an id counts once, however many rows have it, so the sample keeps its bound
    texts = found.groupBy("_id", "_toxic").agg(F.min("x").alias("x")).select("_toxic", F.col("x.text").alias("_text"))
    folder = Folder()

    def fold(c: dict) -> list:
        folded = [folder(t) for t in c["_text"].to_pylist()]
        return [folded, [signature(f) for f in folded]]

    train = written(add_columns(texts, "_folded string, _signature long", fold).drop("_text").withColumn("_fold", F.pmod(F.xxhash64("_signature"), F.lit(2)).cast("int")), "toxic-sample")
    train = written(train.groupBy("_signature", "_toxic", "_fold").agg(F.min("_folded").alias("_folded")), "toxic-train")
    sizes = {(r["_fold"], int(r["_toxic"])): r["count"] for r in train.groupBy("_fold", "_toxic").count().collect()}
    size = lambda fold, label: sizes.get((fold, label), 0)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        kind = pa.schema([("feature", pa.string()), ("kind", pa.int32()), ("n", pa.int64())])

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f for f, _ in counts], pa.string()), pa.array([k for _, k in counts], pa.int32()), pa.array(counts.values(), pa.int64())], schema=kind)

        for b in batches:
            for f, label, fold in zip(*(b.column(i).to_pylist() for i in range(3)), strict=True):
                counts.update((x, 2 * fold + int(label)) for x in beginnings(f))
                if len(counts) > HELD:
                    yield out()
                    counts = Counter()
        yield out()

    raw = map_batches(train.select("_folded", "_toxic", "_fold"), count, "feature string, kind int, n long")
    sums = [F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(c) for k, c in enumerate(("c0", "t0", "c1", "t1"))]
    features = written(raw.groupBy("feature").agg(*sums), "toxic-features")
    all_t, all_c = size(0, 1) + size(1, 1), size(0, 0) + size(1, 0)
    lean = F.log((F.col("t0") + F.col("t1") + 0.5) / (all_t + 1.0)) - F.log((F.col("c0") + F.col("c1") + 0.5) / (all_c + 1.0))

    def passes(*folds: int) -> Column:
        """The test of :func:`lexicon`, a little looser, so that only what may pass is collected."""
        t, c = (sum((F.col(f"{x}{f}") for f in folds), F.lit(0)) for x in "tc")
        n_t, n_c = sum(size(f, 1) for f in folds), sum(size(f, 0) for f in folds)
        value = F.log((t + 0.5) / (n_t + 1.0)) - F.log((c + 0.5) / (n_c + 1.0))
        return (value > PURE - 1e-6) & (value - SURE * F.sqrt(1 / (t + 0.5) + 1 / (c + 0.5)) > MARGIN - 1e-6)

    strong = without_shorter(features.where("t0 + t1 >= 3").where(passes(0) | passes(1) | passes(0, 1)).collect())

    def lexicon(folds: tuple[int, ...]) -> dict[str, float]:
        n_t, n_c = sum(size(f, 1) for f in folds), sum(size(f, 0) for f in folds)
        out = {}
        for r in strong:
            value, sure = log_odds(sum(r[f"t{f}"] for f in folds), sum(r[f"c{f}"] for f in folds), n_t, n_c)
            if value > PURE and sure > MARGIN:
                out[r["feature"]] = sure
        return out

    final = lexicon((0, 1))
    innocent = tuple(f" {e}" for e in exceptions)
    if final:
        extends = F.lit(False)
        for k in sorted({len(p) for p in final if not p.endswith(" ")}):
            extends = extends | (F.substring("feature", 1, k).isin([p for p in final if len(p) == k]) & (F.length("feature") > k))
        learned = features.where(extends & (lean <= 0) & (F.col("c0") + F.col("c1") >= 3)).select("feature").collect()
        innocent += tuple(r["feature"] for r in learned if r["feature"] not in final)
    # each fold is scored by the other fold's lexicon, so that evidence is as for unseen texts
    crossed = [Lexicon(lexicon((1,)), innocent), Lexicon(lexicon((0,)), innocent)]

    def weigh(c: dict) -> list:
        return [list(x) for x in zip(*(crossed[f].evidence(t) for f, t in zip(c["_fold"].to_pylist(), c["_folded"].to_pylist(), strict=True)), strict=True)] or [[], []]

    rows = add_columns(train, "_total double, _dense double", weigh).select("_total", "_dense", "_toxic").collect()  # the sample's size at most
    x, y = np.log1p(np.array([[r[0], r[1]] for r in rows], float).reshape(-1, 2)), np.array([r[2] for r in rows], float)
    beta = fit_scores(x, y) if len(rows) else np.zeros(3)
    if all_t and all_c and n.get(1) and n.get(0):  # from the sample's share of toxic rows to that of all labelled rows
        beta[0] += math.log(n[1] / n[0]) - math.log(all_t / all_c)
    return Lexicon(final, innocent, tuple(beta.tolist()))


def score_documents(docs: DataFrame, lexicon: Lexicon, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with the score of ``text``, 0 to 1; null and empty texts score as texts without evidence.

    Only the text is looked at, the whole of it. Repeated rows stay; other columns pass.
    """
    folder = Folder()

    @F.arrow_udf("double")
    def score(texts: pa.Array) -> pa.Array:
        return pa.array([lexicon.score(folder(t)) for t in texts.to_pylist()], pa.float64())

    bound_batches(docs.sparkSession)
    return docs.drop(out).withColumn(out, score(F.col(text)))


def reject_toxic(docs: DataFrame, lexicon: Lexicon, text: str = "text", threshold: float = 0.5) -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, with the columns of ``docs``.

    Null and empty texts have no evidence and stay unless the lexicon's base rate reaches the
    threshold; repeated rows are treated alike; an empty table gives an empty result.
    """
    (score,) = fresh(docs, "_toxicity")
    return score_documents(docs, lexicon, text, score).where(F.col(score) < threshold).drop(score)
