"""Mixes sources to target weights by iterative proportional fitting.

Documents fall into cells (source, language, topic) with their tokens. The cells' tokens are
raked until the shares of each margin equal its targets; the factor of a cell is the weight
of its tokens. A document is then kept with a probability in proportion to its weight,
capped at 1, calibrated so that the expected tokens equal the budget. The draw is a hash of
doc_id and the seed: the same on every run and on every machine.

Topics are clusters of a language's documents: k-means over hashed, weighted words, fitted on
all rows that have words. Word weights count every such row, seeds are drawn from all of them
in proportion to their distance, and each round assigns every row; a round is a Spark job over
written vectors. Vectors and centres are whole numbers, so sums are exact and neither the order
nor the partitions of the rows change a centre. Topics are named language/number, number 0 the
largest; a language with fewer than ``FEWEST`` such rows has one topic, and texts without words
have number 0. The driver holds 10 KB a language of ``FEWEST`` rows or more.

Null source or language counts as ''. Null and empty texts have no tokens; they are kept like
their cell. A margin's targets default to its own shares to the power ``temper``, made to sum
to 1 (topics: within their language's target); given targets are used for the categories that
occur, others get 0. Repeated rows draw alike. Extra columns are kept by ``mix``, whatever
their names, and left out by the query. An empty table gives an empty result.

Up to ``max_cells`` cells are raked on the driver; more are raked where they are, by the same
steps as Spark jobs over the written cells.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, saved

MARGINS = ("_source", "_lang", "_topic")
#: Topics of a language, hashed words, and rows of a language below which it has one topic.
TOPICS, BUCKETS, FEWEST = 4, 256, 40
#: Vectors and centres have length 1 in these units.
UNIT, CENTRE_UNIT = 32_767, 1 << 20
#: Languages whose sums a task holds at once, before it hands them on.
HELD = 500
#: Cells that the driver rakes and broadcasts at most: about 100 bytes each.
MAX_CELLS = 100_000


def token_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+")).cast("long")


_seen: dict[str, int] = {}


def word_counts(text: str | None, buckets: int = BUCKETS) -> np.ndarray:
    """How often words of each hashed bucket occur."""
    words = Counter((text or "").lower().split())
    if len(_seen) > 200_000:
        _seen.clear()
    at = []
    for w in words:
        h = _seen.get(w)
        if h is None:
            h = _seen[w] = zlib.crc32(w.encode("utf-8", "surrogatepass"))
        at.append(h % buckets)
    return np.bincount(np.array(at, np.int64), np.fromiter(words.values(), np.float64, len(words)), buckets)


def _unit(x: np.ndarray) -> np.ndarray:
    size = np.linalg.norm(x, axis=-1, keepdims=True)
    return np.divide(x, size, out=np.zeros_like(x), where=size > 0)


def kmeans(x: np.ndarray, k: int, rounds: int = 30, seed: int = 5) -> np.ndarray:
    """Unit centres of unit rows in memory, the largest cluster's first; begun with rows drawn by their distance to those before. What ``fit_topics`` is held against."""
    rng = np.random.default_rng(seed)
    centres = x[rng.integers(len(x), size=1)]
    while len(centres) < k:
        far = np.clip(1 - (x @ centres.T).max(1), 0, None)
        if far.sum() <= 1e-9:
            break
        centres = np.vstack([centres, x[rng.choice(len(x), p=far / far.sum())]])
    for _ in range(rounds):
        own = (x @ centres.T).argmax(1)
        new = _unit(np.vstack([x[own == i].sum(0) if (own == i).any() else centres[i] for i in range(len(centres))]))
        if np.allclose(new, centres):
            break
        centres = new
    sizes = np.bincount((x @ centres.T).argmax(1), minlength=len(centres))
    return centres[np.argsort(-sizes, kind="stable")]


def vectors(counts: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Weighted logarithms of counts at length 1, in whole units."""
    return np.rint(_unit(np.log1p(counts) * weight) * UNIT).astype("<i2")


def _matrix(column: pa.Array, kind: str) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def _by_lang(langs: pa.Array) -> Iterator[tuple[str, np.ndarray]]:
    """Each language with its rows."""
    coded = langs.dictionary_encode()
    codes = coded.indices.to_numpy()
    for i, lang in enumerate(coded.dictionary.to_pylist()):
        yield lang, np.flatnonzero(codes == i)


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows with counts of words in the place of their text, the last column."""
    for batch in batches:
        counts = [word_counts(t).astype("<i4").tobytes() for t in batch.column(batch.num_columns - 1).to_pylist()]
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(counts, pa.binary())], [*batch.schema.names[:-1], "counts"])


def _partial(kept: dict[str, np.ndarray]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(kept), pa.string()), pa.array([v.tobytes() for v in kept.values()], pa.binary())], ["_lang", "sums"])


def _summed(rows: DataFrame, add, least: int = 0) -> DataFrame:
    """_lang, sums: what ``add`` (of a batch: pairs of a language and whole numbers) finds in all rows of the language; where the first sum is ``least`` or more."""

    def part(batches):
        kept: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, found in add(batch):
                kept[lang] = kept[lang] + found if lang in kept else found
            if len(kept) > HELD:
                yield _partial(kept)
                kept = {}
        yield _partial(kept)

    def whole(pdf: pd.DataFrame) -> pd.DataFrame:  # a row a task and language
        total = sum(np.frombuffer(x, "<i8") for x in pdf["sums"])
        return pd.DataFrame({"_lang": pdf["_lang"].iloc[:1], "sums": [total.tobytes()]})[: int(total[0] >= least)]

    schema = "_lang string, sums binary"
    return rows.mapInArrow(part, schema).groupBy("_lang").applyInPandas(whole, schema)


def _word_weights(counted: DataFrame) -> dict[str, np.ndarray]:
    """Word weights of each language that has enough rows with words."""

    def add(batch):
        counts = _matrix(batch.column(1), "<i4")
        for lang, at in _by_lang(batch.column(0)):
            mine = counts[at] > 0
            yield lang, np.concatenate([[mine.any(1).sum()], mine.sum(0)]).astype("<i8")

    out = {}
    for lang, sums in _summed(counted.select("_lang", "counts"), add, FEWEST).collect():
        n, *df = np.frombuffer(sums, "<i8").tolist()
        out[lang] = np.log((1 + n) / (1 + np.array(df)))
    return out


def _weighted(batches: Iterator[pa.RecordBatch], weights: dict[str, np.ndarray]) -> Iterator[pa.RecordBatch]:
    """The rows with their vector in the place of their counts; null in languages of one topic."""
    for batch in batches:
        langs, counts = batch.column(batch.schema.get_field_index("_lang")), _matrix(batch.column(batch.num_columns - 1), "<i4")
        out: list[bytes | None] = [None] * batch.num_rows
        for lang, at in _by_lang(langs):
            if lang in weights:
                for i, x in zip(at.tolist(), vectors(counts[at], weights[lang]), strict=True):
                    out[i] = x.tobytes()
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out, pa.binary())], [*batch.schema.names[:-1], "x"])


def _nearest(x: np.ndarray, centres: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(number of the nearest centre, whole product with it) of each row; ties go to the first."""
    products = x.astype(np.float64) @ centres.T.astype(np.float64)  # below 2**53, so exact
    own = products.argmax(1)
    return own, products[np.arange(len(x)), own]


def _in_units(x: np.ndarray) -> np.ndarray:
    return np.rint(_unit(x.astype(np.float64)) * CENTRE_UNIT).astype("<i8")


def _next_seed(rows: DataFrame, model: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """One row more a language, of all rows, drawn in proportion to their distance to the centres before."""

    def drawn(batches):
        for batch in batches:
            x, h = _matrix(batch.column(2), "<i2"), batch.column(1).to_numpy()
            key = -np.log(((h.view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53))
            langs, keys, best = [], [], []
            for lang, at in _by_lang(batch.column(0)):
                size, far = np.linalg.norm(x[at].astype(np.float64), axis=1), (x[at] != 0).any(1).astype(np.float64)
                if len(model[lang]):
                    own, product = _nearest(x[at], model[lang])
                    far *= 1 - product / np.maximum(size * np.linalg.norm(model[lang].astype(np.float64), axis=1)[own], 1)
                apart = far > 1e-6  # else a copy of a centre
                if apart.any():
                    key_at = np.where(apart, key[at] / np.maximum(far, 1e-6), np.inf)
                    first = key_at.argmin()
                    langs.append(lang)
                    keys.append(float(key_at[first]))
                    best.append(x[at[first]].tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(keys, pa.float64()), pa.array(best, pa.binary())], ["_lang", "key", "x"])

    least = rows.select("_lang", "h", "x").mapInArrow(drawn, "_lang string, key double, x binary").groupBy("_lang").agg(F.min(F.struct("key", "x")).alias("least"))
    return {r[0]: np.frombuffer(r[1], "<i2") for r in least.select("_lang", "least.x").collect()}


def _round(rows: DataFrame, model: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Of each language and centre: the number of its rows and their sum."""

    def add(batch):
        x = _matrix(batch.column(1), "<i2")
        for lang, at in _by_lang(batch.column(0)):
            mine = x[at]
            mine = mine[(mine != 0).any(1)]
            own = _nearest(mine, model[lang])[0]
            yield lang, np.vstack([np.concatenate([[(own == i).sum()], mine[own == i].sum(0, dtype=np.int64)]) for i in range(len(model[lang]))]).astype("<i8").ravel()

    return {lang: np.frombuffer(sums, "<i8").reshape(-1, BUCKETS + 1) for lang, sums in _summed(rows.select("_lang", "x"), add).collect()}


def _centres(rows: DataFrame, langs: list[str], topics: int, rounds: int = 30) -> dict[str, np.ndarray]:
    """Centres of each language, the largest cluster's first: k-means over every row that has a vector."""
    model = {lang: np.empty((0, BUCKETS), np.int64) for lang in langs}
    for _ in range(topics):
        for lang, x in _next_seed(rows.where(F.col("_lang").isin(list(model))), model).items():
            model[lang] = np.vstack([model[lang], _in_units(x)])
    sizes: dict[str, np.ndarray] = {}
    moving = {lang for lang in langs if len(model[lang])}
    for _ in range(rounds):
        if not moving:
            break
        for lang, sums in _round(rows.where(F.col("_lang").isin(sorted(moving))), {m: model[m] for m in moving}).items():
            n, old = sums[:, 0], model[lang]
            new = np.where(n[:, None] > 0, _in_units(sums[:, 1:]), old)
            model[lang], sizes[lang] = new, n
            if np.abs(new - old).max() <= CENTRE_UNIT * 1e-4:
                moving.discard(lang)
    return {lang: model[lang][np.argsort(-sizes[lang], kind="stable")] for lang in langs if lang in sizes}


def _fitted(docs: DataFrame, keep: tuple[str, ...], topics: int) -> tuple[DataFrame, dict[str, tuple[np.ndarray, np.ndarray]]]:
    """(written rows with the columns ``keep``, _lang, h and x; model). ``docs`` has _lang."""
    ids = F.xxhash64(F.lit(3), F.col("doc_id").cast("long"), "text").alias("h")
    rows = docs.select(*keep, "_lang", ids, "text")
    schema = ", ".join(f"`{n}` {t}" for n, t in rows.drop("text").dtypes)
    counted = saved(rows.mapInArrow(_counted, f"{schema}, counts binary"), "mixing-words", compression="zstd")
    weights = _word_weights(counted)
    weighed = saved(counted.mapInArrow(lambda it: _weighted(it, weights), f"{schema}, x binary"), "mixing-vectors", compression="zstd")
    discard(counted)
    centres = _centres(weighed.where("x is not null"), sorted(weights), topics) if weights else {}
    return weighed, {lang: (weights[lang], c) for lang, c in centres.items()}


def fit_topics(docs: DataFrame, topics: int = TOPICS) -> dict[str, tuple[np.ndarray, np.ndarray]]:
    """(word weights, centres) of each language that has enough rows with words, fitted on all of them."""
    rows, model = _fitted(docs.select("doc_id", "text", F.coalesce("lang", F.lit("")).alias("_lang")), (), topics)
    discard(rows)
    return model


def topic_of(text: Column, lang: Column, model: dict) -> Column:
    """language/number of the centre nearest to each text."""

    @F.pandas_udf("string")
    def nearest(texts: pd.Series, langs: pd.Series) -> pd.Series:
        out = []
        for t, one in zip(texts, langs, strict=True):
            weight, centres = model.get(one, (None, None))
            out.append(f"{one}/{0 if weight is None else int(_nearest(vectors(word_counts(t), weight)[None], centres)[0][0])}")
        return pd.Series(out, dtype=object)

    return nearest(text, F.coalesce(lang, F.lit("")))


def _topic_of_vector(x: Column, lang: Column, model: dict) -> Column:
    """The same of vectors that are written already."""

    @F.pandas_udf("string")
    def nearest(xs: pd.Series, langs: pd.Series) -> pd.Series:
        out = np.array([f"{one}/0" for one in langs], dtype=object)
        for lang, at in langs.groupby(langs).indices.items():
            if lang in model:
                own = _nearest(np.frombuffer(b"".join(xs.iloc[at]), "<i2").reshape(len(at), -1), model[lang][1])[0]
                out[at] = [f"{lang}/{i}" for i in own.tolist()]
        return pd.Series(out, dtype=object)

    return nearest(x, lang)


def rake(counts: np.ndarray, codes: list[np.ndarray], targets: list[np.ndarray], rounds: int = 200, tolerance: float = 1e-9) -> np.ndarray:
    """Cells fitted to the targets of each margin in turn; they sum to 1. Empty cells stay empty."""
    fitted, worst = counts / counts.sum(), 0.0
    for _ in range(rounds):
        last, worst = worst, 0.0
        for code, target in zip(codes, targets, strict=True):
            have = np.bincount(code, fitted, len(target))
            factor = np.divide(target, have, out=np.zeros_like(have), where=have > 0)
            fitted = fitted * factor[code]
            worst = max(worst, float(np.abs(np.where(have > 0, have - target, 0)).max()))
        if worst < tolerance or abs(worst - last) < tolerance:  # targets that no cells can meet leave a distance
            break
    return fitted / fitted.sum() if fitted.sum() else fitted


def calibrate(counts: np.ndarray, weight: np.ndarray, budget: float) -> np.ndarray:
    """Probabilities min(1, c * weight) whose expected tokens equal the budget, as far as weights above 0 reach."""
    order = np.argsort(-weight, kind="stable")
    n, w = counts[order], weight[order]
    left, mass = budget, float((n * w).sum())
    p = np.zeros(len(n))
    for i in range(len(n)):
        if mass <= 0:
            break
        if left / mass * w[i] < 1:  # nor will any later one be capped
            p[i:] = np.minimum(1.0, left / mass * w[i:])
            break
        p[i], left, mass = float(w[i] > 0), left - n[i] * (w[i] > 0), mass - n[i] * w[i]
    out = np.empty_like(p)
    out[order] = np.clip(p, 0, 1)
    return out


def _labelled(docs: DataFrame, topic: Column) -> DataFrame:
    return docs.withColumns({"_source": F.coalesce("source", F.lit("")), "_lang": F.coalesce("lang", F.lit("")), "_topic": F.coalesce(topic, F.lit("")), "_tokens": token_count(F.col("text"))})


def _tempered(have: np.ndarray, temper: float) -> np.ndarray:
    return np.where(have > 0, have**temper, 0)


def _driver_weights(rows: list, targets: dict, keep: float, temper: float, nested: bool) -> list[tuple]:
    rows.sort(key=lambda r: tuple(r[m] for m in MARGINS))
    counts = np.array([float(r["n"]) for r in rows])
    if not rows or counts.sum() == 0:
        return [(*(r[m] for m in MARGINS), 1.0, float(keep)) for r in rows]
    codes, wanted = [], []
    for name, m in zip(("source", "lang", "topic"), MARGINS, strict=True):
        values, code = np.unique([r[m] for r in rows], return_inverse=True)
        have = np.bincount(code, counts, len(values))
        given = targets.get(name)
        want = np.array([float(given.get(v, 0.0)) for v in values.tolist()]) if given else _tempered(have, temper)
        if name == "topic" and nested and not given:  # a topic has one language
            of = np.zeros(len(values), np.int64)
            of[code] = codes[1]
            whole = np.bincount(of, want, len(wanted[1]))[of]
            want = np.divide(want * wanted[1][of], whole, out=np.zeros_like(want), where=whole > 0)
        codes.append(code)
        wanted.append(want / want.sum() if want.sum() > 0 else have / have.sum())
    share = counts / counts.sum()
    weight = np.divide(rake(counts, codes, wanted), share, out=np.ones_like(share), where=share > 0)
    p = np.where(counts > 0, calibrate(counts, weight, keep * counts.sum()), keep)  # cells without tokens
    return [(*(r[m] for m in MARGINS), float(w), float(q)) for r, w, q in zip(rows, weight, p, strict=True)]


def _spark_weights(cells: DataFrame, targets: dict, keep: float, temper: float, nested: bool, rounds: int = 200, tolerance: float = 1e-9) -> DataFrame:
    """The same by Spark: a factor a category, each step sums the cells with the other margins' factors. A table of factors a step is written."""
    spark, total = cells.sparkSession, float(cells.agg(F.sum("n")).first()[0] or 0)
    if total == 0:
        return cells.select(*MARGINS, F.lit(1.0).alias("weight"), F.lit(float(keep)).alias("probability"))
    share = F.col("n") / total
    goals: dict[str, DataFrame] = {}
    for name, m in zip(("source", "lang", "topic"), MARGINS, strict=True):
        by = [m, "_lang"] if name == "topic" and nested and not targets.get(name) else [m]
        have = cells.groupBy(*by).agg(F.sum(share).alias("have"))
        own = F.when(F.col("have") > 0, F.pow("have", F.lit(temper))).otherwise(0.0)
        if len(by) == 2:
            whole = have.withColumn("want", own).join(goals["_lang"].withColumnRenamed("goal", "of"), "_lang")
            sums = have.withColumn("want", own).groupBy("_lang").agg(F.sum("want").alias("all"))
            want = whole.join(sums, "_lang").withColumn("want", F.when(F.col("all") > 0, F.col("want") * F.col("of") / F.col("all")).otherwise(0.0))
        elif given := targets.get(name):
            want = have.join(spark.createDataFrame([(k, float(v)) for k, v in given.items()], f"{m} string, want double"), m, "left").fillna(0.0, ["want"])
        else:
            want = have.withColumn("want", own)
        want = saved(want.select(m, "have", "want"), "mixing-goals")
        summed = want.agg(F.sum("want")).first()[0]
        goals[m] = saved(want.select(m, (F.col("want") / summed if summed > 0 else F.col("have")).alias("goal")), "mixing-goals")
    factors = {m: goals[m].select(m, F.lit(1.0).alias("factor")) for m in MARGINS}

    def scaled() -> DataFrame:
        out = cells.withColumn("fit", share)
        for m in MARGINS:
            out = out.join(factors[m], m).withColumn("fit", F.col("fit") * F.col("factor")).drop("factor")
        return out

    worst = 0.0
    for _ in range(rounds):
        last, worst = worst, 0.0
        for m in MARGINS:
            now = scaled().groupBy(m).agg(F.sum("fit").alias("fit")).join(factors[m], m).join(goals[m], m)
            now = saved(now.select(m, F.when(F.col("fit") > 0, F.col("factor") * F.col("goal") / F.col("fit")).otherwise(0.0).alias("factor"), F.when(F.col("fit") > 0, F.abs(F.col("fit") - F.col("goal"))).otherwise(0.0).alias("off")), "mixing-factors")
            worst, factors[m] = max(worst, now.agg(F.max("off")).first()[0]), now.drop("off")
        if worst < tolerance or abs(worst - last) < tolerance:
            break
    fitted = saved(scaled(), "mixing-fitted")
    mass = fitted.agg(F.sum("fit")).first()[0]
    weighed = fitted.withColumn("weight", F.when(F.col("n") > 0, F.col("fit") / (mass or 1.0) / share).otherwise(1.0))
    # the scale rises while more cells are capped, so it ends
    scale, n, w = 0.0, F.col("n").cast("double"), F.col("weight")
    while True:
        capped, rest = weighed.where("n > 0").agg(F.coalesce(F.sum(F.when(w * scale >= 1, n)), F.lit(0.0)), F.coalesce(F.sum(F.when(w * scale < 1, n * w)), F.lit(0.0))).first()
        new = (keep * total - capped) / rest if rest > 0 else scale
        if new <= scale * (1 + 1e-12):
            break
        scale = new
    return weighed.select(*MARGINS, "weight", F.when(F.col("n") > 0, F.least(F.lit(1.0), w * scale)).otherwise(float(keep)).alias("probability"))


def cell_weights(labelled: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = 0.5, temper: float = 0.5, max_cells: int = MAX_CELLS, nested: bool = False) -> DataFrame:
    """_source, _lang, _topic, weight, probability of every cell; fit for a broadcast up to ``max_cells``. ``nested``: a topic has one language."""
    cells = labelled.groupBy(*MARGINS).agg(F.sum("_tokens").alias("n"))
    cells = saved(cells, "mixing-cells")
    if cells.count() > max_cells:
        return _spark_weights(cells, targets or {}, keep, temper, nested)
    schema = "_source string, _lang string, _topic string, weight double, probability double"
    return F.broadcast(labelled.sparkSession.createDataFrame(_driver_weights(cells.collect(), targets or {}, keep, temper, nested), schema))


def _drawn(seed: int) -> Column:
    """Evenly spread over [0, 1) by doc_id."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.coalesce(F.col("doc_id").cast("long"), F.lit(-1))), 11).cast("double") / float(1 << 53)


def mix(docs: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = 0.5, temper: float = 0.5, seed: int = 17, topic: Column | None = None) -> DataFrame:
    """The sampled documents, with their own columns."""
    # the documents' own columns stay apart, whatever their names
    given = topic_of(F.col("text"), F.col("lang"), fit_topics(docs)) if topic is None else topic
    labelled = _labelled(docs.select(F.struct("*").alias("_row"), "doc_id", "text", "source", "lang", given.alias("_given")), F.col("_given"))
    weights = cell_weights(labelled.select(*MARGINS, "_tokens"), targets, keep, temper, nested=topic is None).select(*MARGINS, F.col("probability").alias("_probability"))
    return labelled.join(weights, [*MARGINS]).where(_drawn(seed) < F.col("_probability")).select("_row.*")


def op10_mixing(spark: SparkSession, docs: DataFrame, seed: int = 17) -> DataFrame:
    """doc_id, source, lang, topic, n_tokens, weight, probability, kept for every document."""
    docs = docs.select("doc_id", "text", "source", "lang")
    rows, model = _fitted(_labelled(docs, F.lit("")), ("doc_id", "_source", "_tokens"), TOPICS)  # vectors instead of texts from here
    narrow = saved(rows.select("doc_id", "_source", "_lang", "_tokens", _topic_of_vector(F.col("x"), F.col("_lang"), model).alias("_topic")), "mixing")
    discard(rows)
    out = narrow.join(cell_weights(narrow, nested=True), [*MARGINS])
    return out.select(
        "doc_id", F.col("_source").alias("source"), F.col("_lang").alias("lang"), F.col("_topic").alias("topic"), F.col("_tokens").alias("n_tokens"),
        F.round("weight", 9).alias("weight"), F.round("probability", 9).alias("probability"), (_drawn(seed) < F.col("probability")).alias("kept"),
    )
