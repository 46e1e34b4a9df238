"""Quality scores: random-indexing word vectors, pooled per document, and a two-layer network."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vernissage.llm import bytewords as bw
from vernissage.llm.text import fixed_partitions
from vernissage.session import land

# Bytes of letters, digits and non-ASCII text are one class, other visible bytes the other.
_CLASSES = np.where(bw.SPACE_BYTES, 0, np.where(bw.NOT_ALNUM_BYTES, 2, 1)).astype(np.uint8)
_CLASSES[ord("A") : ord("Z") + 1] = 1
# Vectors of the words of a pooled slice fit into a core's cache; sums of contexts gain from longer slices,
# whose words are hashed in shorter ones.
_POOL_BYTES = 1 << 15
_HASH_BYTES = 1 << 18
_SUM_BYTES = 1 << 21
_WORD_SEED, _INDEX_SEED = 11, 12
_EXTRA = 4


@dataclass(frozen=True)
class Settings:
    """Sizes of the model; none depends on the corpus.

    Words are hashed into `vocabulary` rows of `width` numbers; each has an index
    vector with `nonzeros` random signs and gathers those of the words within
    `reach` places. `fit_rows` bounds the labelled documents the network is
    fitted on: those with the smallest hashes of their keys.
    """

    vocabulary: int = 1 << 14
    width: int = 64
    nonzeros: int = 4
    reach: int = 2
    ranges: int = 16
    fit_rows: int = 20_000
    hidden: int = 32
    epochs: int = 40
    batch: int = 256
    rate: float = 3e-3
    decay: float = 1e-4
    calibration: float = 0.2
    threshold: float = 0.3
    seed: int = 5


def _tokens(texts: pa.Array, settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(row of the vocabulary per token, first token per text)."""
    tokens, firsts, seen = [np.zeros(0, dtype=np.int64)], [np.zeros(1, dtype=np.int64)], 0
    for a, b in bw.slices(texts, _HASH_BYTES):
        data, offsets = bw.text_bytes(texts.slice(a, b - a))
        start, end, first = bw.token_spans(data, offsets, _CLASSES)
        tokens.append((bw.word_hashes(data, start, end, _WORD_SEED) % np.uint64(settings.vocabulary)).astype(np.int64))
        firsts.append(first[1:] + seen)
        seen += len(start)
    return np.concatenate(tokens), np.concatenate(firsts)


def index_vectors(settings: Settings) -> tuple[np.ndarray, np.ndarray]:
    """(places, signs), each vocabulary x nonzeros, from a seed."""
    cells = np.arange(settings.vocabulary * settings.nonzeros, dtype=np.uint64) + np.uint64(_INDEX_SEED << 40)
    bits = bw.mixed(cells).reshape(settings.vocabulary, settings.nonzeros)
    return (bits % np.uint64(settings.width)).astype(np.int64), np.where(bits >> np.uint64(63), 1.0, -1.0)


def context_sums(texts: pa.Array, settings: Settings) -> np.ndarray:
    """vocabulary x width: index vectors of neighbours, summed over all tokens of the texts."""
    token, first = _tokens(texts, settings)
    text = np.repeat(np.arange(len(first) - 1), np.diff(first))
    places, signs = index_vectors(settings)
    cells = settings.vocabulary * settings.width
    sums = np.zeros(cells)
    for step in range(1, settings.reach + 1):
        if len(token) <= step:
            break
        pair = text[step:] == text[:-step]
        left, right = token[:-step][pair], token[step:][pair]
        for word, other in ((left, right), (right, left)):
            for k in range(settings.nonzeros):
                sums += np.bincount(word * settings.width + places[other, k], signs[other, k], cells)
    return sums.reshape(settings.vocabulary, settings.width)


def word_vectors(docs: DataFrame, text: str = "text", settings: Settings = Settings()) -> np.ndarray:
    """Word vectors learned from every text: unit vectors of context sums plus the word's own index vector.

    A task adds up all its texts and sends one matrix, cut into ranges of rows;
    ranges are added in two rounds of streaming sums. Only the finished matrix,
    of a size fixed by the settings, reaches the driver.
    """
    per_range = settings.vocabulary // settings.ranges

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, salt, seen = np.zeros((settings.vocabulary, settings.width)), 0, False
        for batch in batches:
            texts = batch.column(0)
            seen = seen or len(texts) > 0
            for a, b in bw.slices(texts, _SUM_BYTES):
                sums += context_sums(texts.slice(a, b - a), settings)
            salt = (salt + int(np.abs(sums).sum())) % 64
        if seen:
            parts = [sums[i * per_range : (i + 1) * per_range].astype(np.float32).tobytes() for i in range(settings.ranges)]
            yield pa.RecordBatch.from_pydict({"part": list(range(settings.ranges)), "salt": [salt] * settings.ranges, "sums": parts}, schema=_schema)

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, np.ndarray] = {}
        for batch in batches:
            for part, sums in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True):
                held[part] = held.get(part, 0) + np.frombuffer(sums, dtype=np.float32).astype(np.float64)
        if held:
            yield pa.RecordBatch.from_pydict({"part": list(held), "salt": [0] * len(held), "sums": [v.astype(np.float32).tobytes() for v in held.values()]}, schema=_schema)

    _schema = pa.schema([("part", pa.int32()), ("salt", pa.int32()), ("sums", pa.binary())])
    form = "part int, salt int, sums binary"
    parts = docs.select(F.col(text)).mapInArrow(partial, form)
    parts = fixed_partitions(parts, "part", "salt").mapInArrow(add, form).repartition(settings.ranges, "part").mapInArrow(add, form)
    matrix = np.zeros((settings.vocabulary, settings.width))
    for row in parts.collect():
        at = row["part"] * per_range
        matrix[at : at + per_range] = np.frombuffer(row["sums"], dtype=np.float32).reshape(per_range, -1)
    places, signs = index_vectors(settings)
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    matrix = matrix / np.where(norms > 0, norms, 1.0)
    np.add.at(matrix, (np.arange(settings.vocabulary)[:, None], places), signs / np.sqrt(settings.nonzeros))
    norms = np.linalg.norm(matrix, axis=1, keepdims=True)
    return (matrix / np.where(norms > 0, norms, 1.0)).astype(np.float32)


def pooled(texts: pa.Array, vectors: np.ndarray, settings: Settings) -> np.ndarray:
    """Per text: mean and mean square of its word vectors, mean likeness of neighbouring words and
    share of neighbours that are alike, the length of the mean, log of the token count."""
    token, first = _tokens(texts, settings)
    counts = np.diff(first)
    out = np.zeros((len(counts), 2 * settings.width + _EXTRA), dtype=np.float32)
    filled = np.flatnonzero(counts)
    if len(filled):
        rows, at, n = vectors[token], first[:-1][filled], counts[filled, None]
        out[filled, : settings.width] = np.add.reduceat(rows, at, axis=0) / n
        out[filled, settings.width : -_EXTRA] = np.add.reduceat(rows * rows, at, axis=0) / n
        alike = np.zeros(len(token), dtype=np.float32)
        alike[:-1] = np.einsum("ij,ij->i", rows[:-1], rows[1:])
        alike[first[1:][filled] - 1] = 0.0
        pairs = np.maximum(counts[filled] - 1, 1)
        out[filled, -4] = np.add.reduceat(alike, at) / pairs
        out[filled, -3] = np.add.reduceat((alike > 0.999).astype(np.float32), at) / pairs
    out[:, -2] = np.linalg.norm(out[:, : settings.width], axis=1)
    out[:, -1] = np.log1p(counts)
    return out


def _pooled_batch(texts: pa.Array, vectors: np.ndarray, settings: Settings) -> np.ndarray:
    return np.concatenate([pooled(texts.slice(a, b - a), vectors, settings) for a, b in bw.slices(texts, _POOL_BYTES)])


@dataclass
class Network:
    """Standardised inputs, one tanh layer, one output, and the temperature of its logits."""

    mean: np.ndarray
    scale: np.ndarray
    w1: np.ndarray
    b1: np.ndarray
    w2: np.ndarray
    b2: float
    temperature: float = 1.0

    def logits(self, x: np.ndarray) -> np.ndarray:
        return np.tanh((x - self.mean) / self.scale @ self.w1 + self.b1) @ self.w2 + self.b2

    def scores(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.logits(x) / self.temperature)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -60.0, 60.0)))


def _constant(width: int, share: float) -> Network:
    flat = np.zeros
    odds = np.log((share + 1e-6) / (1 - share + 1e-6))
    return Network(flat(width), np.ones(width), flat((width, 1)), flat(1), flat(1), float(odds))


def fit_network(x: np.ndarray, y: np.ndarray, settings: Settings = Settings()) -> Network:
    """Adam on the log loss; the temperature is set on rows kept back from the fit.

    With no rows the score is 1/2 everywhere, with one class near that class.
    """
    if len(y) == 0 or y.min() == y.max():
        return _constant(x.shape[1], float(y.mean()) if len(y) else 0.5)
    random = np.random.default_rng(settings.seed)
    order = random.permutation(len(y))
    back = order[: int(len(y) * settings.calibration)]
    rows = order[len(back) :]
    mean, scale = x[rows].mean(0), x[rows].std(0)
    net = Network(
        mean, np.where(scale > 1e-9, scale, 1.0),
        random.normal(0, 1 / np.sqrt(x.shape[1]), (x.shape[1], settings.hidden)), np.zeros(settings.hidden),
        random.normal(0, 1 / np.sqrt(settings.hidden), settings.hidden), 0.0,
    )
    weights = [net.w1, net.b1, net.w2, np.zeros(1)]
    first, second, step = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights], 0
    standard = (x - net.mean) / net.scale
    for _ in range(settings.epochs):
        shuffled = random.permutation(rows)
        for at in range(0, len(shuffled), settings.batch):
            own = shuffled[at : at + settings.batch]
            hidden = np.tanh(standard[own] @ weights[0] + weights[1])
            error = (_sigmoid(hidden @ weights[2] + weights[3][0]) - y[own]) / len(own)
            inner = error[:, None] * weights[2] * (1 - hidden * hidden)
            slopes = [standard[own].T @ inner, inner.sum(0), hidden.T @ error, np.array([error.sum()])]
            step += 1
            for k, slope in enumerate(slopes):
                slope = slope + settings.decay * weights[k]
                first[k] += 0.1 * (slope - first[k])
                second[k] += 0.001 * (slope * slope - second[k])
                weights[k] = weights[k] - settings.rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
    net.w1, net.b1, net.w2, net.b2 = weights[0], weights[1], weights[2], float(weights[3][0])
    if len(back) and y[back].min() != y[back].max():
        logits = net.logits(x[back])
        choices = np.exp(np.linspace(np.log(0.25), np.log(8.0), 101))
        losses = [np.mean(np.logaddexp(0, logits / t) - y[back] * logits / t) for t in choices]
        net.temperature = float(choices[int(np.argmin(losses))])
    return net


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, vectors: np.ndarray, key: str = "doc_id", text: str = "text", label: str = "quality", settings: Settings = Settings()) -> Network:
    """Network from at most `fit_rows` labelled documents outside the held-out fifth."""
    usable = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & ~held_out(F.col(key)))
    one = usable.groupBy(F.col(key).alias("_k")).agg(F.max(label).alias("_y"))
    chosen = land(one.orderBy(F.xxhash64("_k"), "_k").limit(settings.fit_rows), "quality-sample")
    rows = docs.select(F.col(key).alias("_k"), F.col(text).alias("_t")).join(F.broadcast(chosen), "_k").select("_k", "_y", "_t")

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _pooled_batch(batch.column(2), vectors, settings)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.float64()), pa.array([r.tobytes() for r in x], pa.binary())], names=["k", "y", "x"])

    kind = rows.schema["_k"].dataType.simpleString()
    found = rows.mapInArrow(features, f"k {kind}, y double, x binary").orderBy(F.xxhash64("k"), "k", "x").limit(settings.fit_rows).collect()
    width = 2 * settings.width + _EXTRA
    x = np.array([np.frombuffer(r["x"], dtype=np.float32) for r in found], dtype=np.float64).reshape(len(found), width)
    return fit_network(x, np.array([r["y"] for r in found]), settings)


def score(docs: DataFrame, net: Network, vectors: np.ndarray, text: str | list[str] = "text", settings: Settings = Settings()) -> DataFrame:
    """All columns of `docs`, with `score` and `predicted` put last.

    `text` names the column of texts, or the path to it inside a struct. A row goes
    to Python as it is, so a text travels once.
    """
    columns = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
    path = [text] if isinstance(text, str) else text
    rows = docs.select(F.struct(*columns).alias("doc"))

    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if len(batch):
                texts = pc.struct_field(batch.column(0), path)
                values = net.scores(_pooled_batch(texts, vectors, settings))
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(values)], names=["doc", "score"])

    doc = rows.schema["doc"].dataType.simpleString()
    out = rows.mapInArrow(scored, f"doc {doc}, score double")
    passed = (F.col("score") >= settings.threshold).cast("int")
    return out.select(*[F.col("doc")[c].alias(c) for c in columns], "score", passed.alias("predicted"))


def classify(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality", carry: list[str] | None = None, settings: Settings = Settings()) -> DataFrame:
    """`carry` (all columns by default), held_out, score and predicted for every row of `docs`.

    Word vectors come from all texts. The score uses the text only. Null and
    empty texts get the score of a text without tokens. Labels other than 0
    and 1, without a key or without a document are not used; of several labels
    for a key the largest counts. A null key is never held out. Repeated rows
    are scored each. An empty table gives no rows.
    """
    vectors = word_vectors(docs, text, settings)
    net = fit(docs, labels, vectors, key, text, label, settings)
    kept = [c for c in (docs.columns if carry is None else carry) if c.lower() != "held_out"]
    rows = docs.select(*dict.fromkeys([*kept, text]), held_out(F.col(key)).alias("held_out"))
    return score(rows, net, vectors, text, settings).select(*kept, "held_out", "score", "predicted")


def accepted(docs: DataFrame, labels: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The rows of `docs` that the classifier accepts, same columns."""
    vectors = word_vectors(docs, settings=settings)
    net = fit(docs, labels, vectors, settings=settings)
    told = score(docs.select(F.struct("*").alias("_doc")), net, vectors, ["_doc", "text"], settings)
    return told.filter("predicted = 1").select("_doc.*")
