"""Language identification by hierarchical discrimination.

A linear classifier on character n-grams first predicts the language family; within the family, one-versus-one linear support vector machines tell its languages
apart by votes. Families come from ``FAMILIES`` (a language that it doesn't name is a family of its own).

Features of a text are the hashed 1-, 2- and 3-grams of its lower-cased letters (everything else counts as one space), as relative frequencies under a square root. The
models are fitted on a bounded sample of labelled rows: for each language the ``SAMPLE`` distinct texts of lowest hash, about (all rows are counted first, so that the share is known), and never more than
twice as many; only sparse feature vectors and sets of letters, never texts, reach the driver. Each family's and each pair's machine is fitted in a task of its own. Prediction reads the text alone, is a
map over partitions and needs no shuffle.

Beside the score, ``known`` is the share of a text's letters that the predicted language showed in the sample: a text in a script that was never learned gets some language, but little of it is known.

A text that is null or has no letter gets ``und`` with score 0 and nothing known. Rows without a label are not learned from but predicted like any other. If nothing is labelled,
every text gets ``und``. Equal texts get equal predictions (ties fall to the language or family first in order), repeated rows are rows of their own and count once in the sample. Very long texts are read by
pieces. An empty table gives an empty result; other columns are ignored, and ``tagged`` keeps them packed, so that no name can clash.
"""

from __future__ import annotations

from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from .common import map_batches

#: Distinct labelled texts of each language that the classifier is fitted on, about; twice as many at most.
SAMPLE = 400
DIM_BITS = 13
DIM = 1 << DIM_BITS
UNKNOWN = "und"
#: The family of a language code.
FAMILIES = {
    "germanic": ["en", "de", "nl", "af", "sv", "da", "no", "nb", "nn", "is", "fy", "lb", "yi"],
    "romance": ["fr", "es", "pt", "it", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "bg", "mk", "sr", "hr", "bs", "sl", "pl", "cs", "sk"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "uz"],
    "indic": ["hi", "bn", "ur", "mr", "gu", "pa"],
    "sinitic": ["zh", "yue"],
    "semitic": ["ar", "he", "mt"],
}
#: Letters that are read at a time.
PIECE = 1 << 20


def family_of(lang: str) -> str:
    return next((f for f, members in FAMILIES.items() if lang.lower().split("-")[0] in members), lang)


# -- features -------------------------------------------------------------------------------------


def _tables() -> np.ndarray:
    """Of each code point below 2^16, its lower-case letter, or 32 for what isn't a letter."""
    lower = np.full(1 << 16, 32, dtype=np.uint32)
    for c in range(1 << 16):
        if chr(c).isalpha():
            low = chr(c).lower()
            lower[c] = ord(low) if len(low) == 1 else c
    return lower


_LOWER: list[np.ndarray] = []


def lowered(t: str) -> np.ndarray:
    """Lower-case letters of a text, 32 for everything else."""
    u = np.frombuffer(t.encode("utf-32-le"), dtype=np.uint32)
    if not _LOWER:
        _LOWER.append(_tables())
    if (u < 1 << 16).all():
        return _LOWER[0][u]
    far = np.array([ord(c.lower()[0]) if c.isalpha() else 32 for c in map(chr, u[u >= 1 << 16].tolist())], dtype=np.uint32)
    out = _LOWER[0][np.minimum(u, 65535)]
    out[u >= 1 << 16] = far
    return out


@dataclass
class Letters:
    """Which languages showed which letter: letters fall into kinds by the set of languages that did."""

    kind: np.ndarray  # of each code point below 2^16; kind 0 was never seen
    far: dict[int, int]  # of others
    seen: np.ndarray  # whether a kind's letters were seen in a language: kinds x languages

    @classmethod
    def of(cls, sets: list[set[int]]) -> Letters:
        kinds, kind, far = {(False,) * len(sets): 0}, np.zeros(1 << 16, np.int64), {}
        for c in set().union(*sets):
            k = kinds.setdefault(tuple(c in s for s in sets), len(kinds))
            if c < 1 << 16:
                kind[c] = k
            else:
                far[c] = k
        return cls(kind, far, np.array(list(kinds), dtype=float))

    def count(self, u: np.ndarray) -> np.ndarray:
        k = self.kind[np.minimum(u, 65535)]
        if self.far and (u >= 1 << 16).any():
            k = np.where(u >= 1 << 16, [self.far.get(c, 0) for c in u.tolist()], k)
        return np.bincount(k, minlength=len(self.seen))


def features(texts: pa.Array, letters: Letters | None = None) -> tuple[np.ndarray, np.ndarray, list]:
    """A row of DIM features for each text, whether it has a letter, and how many of its letters are of each kind (without ``letters``: which it has)."""
    out, lettered, counts = np.zeros((len(texts), DIM), dtype=np.float32), np.zeros(len(texts), dtype=bool), []
    for i, t in enumerate(texts.to_pylist()):
        total, before, own = np.zeros(DIM), np.array([32], np.uint64), np.zeros(len(letters.seen)) if letters else set()
        for low in range(0, len(t or ""), PIECE):
            u = lowered(t[low : low + PIECE])
            space = u == 32
            u = u[~(space & np.append(before[-1] == 32, space[:-1]))]  # runs of spaces are one
            some = u[u != 32]
            if len(some):
                lettered[i] = True
                if letters:
                    own += letters.count(some)
                else:
                    own |= set(np.unique(some).tolist())
            before = _count(np.concatenate([before[-2:], u]), min(2, len(before)) if low else 0, total)
        if lettered[i]:
            _count(np.append(before[-2:], np.uint64(32)), min(2, len(before)), total)
            out[i] = np.sqrt(total / total.sum())
        counts.append(own)
    return out, lettered, counts


def _count(u: np.ndarray, known: int, total: np.ndarray) -> np.ndarray:
    """Add the n-grams of ``u`` that end behind its first ``known`` letters to ``total``."""
    u = u.astype(np.uint64)
    two = u[:-1] << np.uint64(21) | u[1:]
    three = two[:-1] << np.uint64(21) | u[2:]
    for k, x in enumerate((u[known:], two[max(0, known - 1) :], three[max(0, known - 2) :])):
        total += np.bincount(((x * np.uint64(0x9E3779B97F4A7C15) + np.uint64(k)) * np.uint64(0xD1342543DE82EF95) >> np.uint64(64 - DIM_BITS)).astype(np.int64), minlength=DIM)
    return u


# -- linear support vector machines -----------------------------------------------------------------


def fit_svm(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: float = 10.0, rounds: int = 60, seed: int = 7) -> np.ndarray:
    """Weights (bias last) of a linear SVM by dual coordinate descent over sparse rows (places, values); ``y`` is +1 or -1, classes count alike."""
    rows = [(np.append(at, DIM), np.append(x, 1.0)) for at, x in rows]
    limit = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    square, alpha, w = [float(x @ x) for _, x in rows], np.zeros(len(y)), np.zeros(DIM + 1)
    rng = np.random.default_rng(seed)
    for _ in range(rounds):
        moved = 0.0
        for i in rng.permutation(len(y)):
            at, x = rows[i]
            new = min(max(alpha[i] - (y[i] * (x @ w[at]) - 1) / square[i], 0.0), limit[i])
            if new != alpha[i]:
                w[at] += (new - alpha[i]) * y[i] * x
                moved = max(moved, abs(new - alpha[i]))
                alpha[i] = new
        if moved < 1e-3:
            break
    return w


@dataclass
class Model:
    langs: list[str]
    families: list[str]
    family_weights: np.ndarray  # a row for each family: it against the others
    pairs: dict[str, list[tuple[int, int, np.ndarray]]]  # of a family: language, language, weights
    members: dict[str, list[int]]
    letters: Letters | None = None

    def predict(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language and score of each row."""
        squash = lambda z: 1 / (1 + np.exp(-2 * z))
        z = x @ self.family_weights[:, :-1].T + self.family_weights[:, -1]
        if len(self.families) == 1:
            z = np.full((len(x), 1), 50.0)
        family, score = z.argmax(1), squash(np.clip(z.max(1), -50, 50))
        out = np.zeros(len(x), dtype=np.int64)
        for f, name in enumerate(self.families):
            rows, members = np.flatnonzero(family == f), self.members[name]
            votes, margin = np.zeros((len(rows), len(self.langs))), np.zeros((len(rows), len(self.langs)))
            for a, b, w in self.pairs[name]:
                d = x[rows] @ w[:-1] + w[-1]
                votes[:, a] += d >= 0
                votes[:, b] += d < 0
                margin[:, a] += d
                margin[:, b] -= d
            best = np.array(members)[(votes[:, members] + 1e-6 * np.tanh(margin[:, members])).argmax(1)] if len(members) > 1 else np.full(len(rows), members[0])
            out[rows] = best
            if len(members) > 1:
                score[rows] *= squash(np.clip(margin[np.arange(len(rows)), best] / (len(members) - 1), -50, 50))
        return out, score


def problems(langs: list[str]) -> list[tuple[list[str], list[str], str]]:
    """What is to be told from what: each family from the others, each language from each other one of its family."""
    families = sorted({family_of(g) for g in langs})
    out = [([g for g in langs if family_of(g) == f], [g for g in langs if family_of(g) != f], f) for f in families if len(families) > 1]
    return out + [([a], [b], "") for f in families for a, b in combinations([g for g in langs if family_of(g) == f], 2)]


def solved(problem: tuple, rows: list, labels: list[str]) -> np.ndarray:
    some = [i for i, g in enumerate(labels) if g in problem[0] or g in problem[1]]
    return fit_svm([rows[i] for i in some], np.array([1 if labels[i] in problem[0] else -1 for i in some]))


def assembled(langs: list[str], solutions: list[np.ndarray], letters: Letters | None = None) -> Model:
    families = sorted({family_of(g) for g in langs})
    weights, pairs = np.zeros((len(families), DIM + 1)), {f: [] for f in families}
    for (yes, no, family), w in zip(problems(langs), solutions, strict=True):
        if family:
            weights[families.index(family)] = w
        else:
            pairs[family_of(yes[0])].append((langs.index(yes[0]), langs.index(no[0]), w))
    return Model(langs, families, weights, pairs, {f: [i for i, g in enumerate(langs) if family_of(g) == f] for f in families}, letters)


def fit(x: np.ndarray, labels: list[str]) -> Model:
    """The model of a handful of dense rows, here and now."""
    rows = [(np.flatnonzero(r), r[r != 0].astype(float)) for r in x]
    langs = sorted(set(labels))
    return assembled(langs, [solved(p, rows, labels) for p in problems(langs)])


# -- Spark --------------------------------------------------------------------------------------------


def train(labelled: DataFrame, sample: int = SAMPLE, text: str = "text", lang: str = "lang") -> Model | None:
    """Fit on about ``sample`` distinct texts of each language, those of lowest hash, and never more than twice as many. None if nothing is labelled."""
    rows = labelled.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    counts = {r[0]: r[1] for r in rows.groupBy("lang").agg(F.approx_count_distinct("h")).collect()}
    if not counts:
        return None
    share = F.create_map(*[F.lit(x) for g, n in counts.items() for x in (g, min(1.0, sample / max(1, n)))])
    chosen = rows.filter(F.shiftrightunsigned("h", 1) / F.lit(float(1 << 63)) <= F.element_at(share, F.col("lang")))
    chosen = chosen.groupBy("lang", "h").agg(F.first("text").alias("text"))
    chosen = chosen.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 1), "h"))).filter(F.col("rank") <= 2 * sample)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        x, _, letters = features(batch.column(2))
        at = [np.flatnonzero(r) for r in x]
        packed = [pa.array([np.array(v, kind).tobytes() for v in some], pa.binary()) for some, kind in ((at, np.uint16), ([r[p] for r, p in zip(x, at, strict=True)], np.float16), ([sorted(s) for s in letters], np.uint32))]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *packed], ["lang", "h", "at", "x", "letters"])

    vectors = map_batches(chosen.select("lang", "h", "text"), lambda: run, "lang string, h long, at binary, x binary, letters binary", max_bytes=1 << 20, max_rows=256).toArrow().to_pylist()
    if not vectors:
        return None
    vectors.sort(key=lambda r: (r["lang"], r["h"]))  # the fit doesn't depend on the order of arrival
    labels, langs = [r["lang"] for r in vectors], sorted({r["lang"] for r in vectors})
    sparse = [(np.frombuffer(r["at"], np.uint16).astype(np.int64), np.frombuffer(r["x"], np.float16).astype(float)) for r in vectors]
    letters = Letters.of([set().union(*[np.frombuffer(r["letters"], np.uint32).tolist() for r in vectors if r["lang"] == g]) for g in langs])
    return assembled(langs, solve_all(labelled.sparkSession, problems(langs), sparse, labels), letters)


def solve_all(spark: SparkSession, wanted: list, rows: list, labels: list[str]) -> list[np.ndarray]:
    """A task for each machine; the sample, bounded by SAMPLE and the number of languages, goes to all of them."""
    if not wanted:
        return []
    shared = spark.sparkContext.broadcast((wanted, rows, labels))

    def run(batches):
        for batch in batches:
            for k in batch.column(0).to_pylist():
                problems_, sparse, names = shared.value
                yield pa.RecordBatch.from_arrays([pa.array([k]), pa.array([solved(problems_[k], sparse, names).tobytes()], pa.binary())], ["k", "w"])

    done = spark.range(len(wanted), numPartitions=len(wanted)).mapInArrow(run, "k long, w binary").collect()
    shared.unpersist()
    return [np.frombuffer(r["w"]) for r in sorted(done, key=lambda r: r["k"])]


SCORES = [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("known", DoubleType())]


def identify(df: DataFrame, model: Model | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key``, ``lang_pred``, ``score`` and ``known`` of every row."""
    shared = df.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), *predictions(shared.value, batch.column(1))], [key, "lang_pred", "score", "known"])

    return map_batches(df.select(key, text), lambda: run, StructType([df.select(key).schema[0], *SCORES]), max_bytes=4 << 20, max_rows=256)


def tagged(df: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``row`` (all columns of ``df``), ``lang_pred``, ``score`` and ``known``: rows pass through the map, so that no join brings them together again, and no column's name can clash."""
    shared = df.sparkSession.sparkContext.broadcast(model)
    packed = df.select(F.struct(*df.columns).alias("row"), F.col(text).alias("text"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([batch.column(0), *predictions(shared.value, batch.column(1))], ["row", "lang_pred", "score", "known"])

    return map_batches(packed, lambda: run, StructType([packed.schema["row"], *SCORES]), max_bytes=4 << 20, max_rows=256)


def predictions(model: Model | None, texts: pa.Array) -> tuple[pa.Array, pa.Array, pa.Array]:
    x, lettered, counts = features(texts, model.letters if model else None)
    names, scores, known = np.full(len(x), UNKNOWN, dtype=object), np.zeros(len(x)), np.zeros(len(x))
    if model is not None and lettered.any():
        best, scores[lettered] = model.predict(x[lettered])
        names[lettered] = np.array(model.langs, dtype=object)[best]
        own = np.stack([c for c, has in zip(counts, lettered, strict=True) if has]) if model.letters else np.ones((len(best), 1))
        seen = model.letters.seen[:, best].T if model.letters else np.ones((len(best), 1))
        known[lettered] = (own * seen).sum(1) / own.sum(1)
    return pa.array(names, pa.string()), pa.array(scores), pa.array(known)


def held_out():
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def predict_documents(docs: DataFrame) -> DataFrame:
    """The contract's columns: doc_id, held_out, lang_pred, score; then known."""
    model = train(docs.filter(~held_out()))
    return identify(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score", "known")
