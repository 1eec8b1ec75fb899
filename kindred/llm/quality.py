"""Quality classifier: a generalised additive model with pairwise interactions, boosted cyclically."""

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from kindred.llm.words import CHUNK, LOWER, text_bytes, word_hashes, word_spans
from kindred.shared import bound_batches, tidy

FEATURES = ("log_bytes", "log_words", "word_bytes", "upper", "digits", "marks", "odd_marks", "shouts", "bars", "beyond_ascii", "distinct_words", "top_word", "distinct_threes", "letterless_words", "short_words", "capital_words", "words_a_stop", "words_a_line", "distinct_lines", "ends_marked")
#: Labelled rows that the model learns from, at most (about; drawn by a hash of doc_id over the whole table).
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 32, 8, 6
ROUNDS, PAIR_ROUNDS, RATE, LEAVES = 120, 60, 0.15, 3

_is = lambda s: np.isin(np.arange(256), np.frombuffer(s, np.uint8))
UPPER, DIGIT = _is(bytes(range(65, 91))), _is(bytes(range(48, 58)))
LETTER = UPPER | _is(bytes(range(97, 123))) | (np.arange(256) >= 128)
MARK = _is(bytes(range(33, 48)) + bytes(range(58, 65)) + bytes(range(91, 97)) + bytes(range(123, 127)))
ODD = _is(b"#$%&*+<=>@[]^_{|}~\\/")
SHOUT, BAR, STOP, LINE = _is(b"!"), _is(b"|"), _is(b".!?"), _is(b"\n")


def _sums(flags: np.ndarray, at: np.ndarray) -> np.ndarray:
    return np.diff(np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])[at])


def _shares(keys: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each text's keys, the share of distinct ones and of the most frequent one; 1 and 0 without keys."""
    n = np.diff(first)
    order = np.lexsort((keys, np.repeat(np.arange(len(n)), n))) if len(keys) else np.zeros(0, np.int64)
    k, doc = keys[order], np.repeat(np.arange(len(n)), n)
    new = np.concatenate([[True], (k[1:] != k[:-1]) | (doc[1:] != doc[:-1])]) if len(k) else np.zeros(0, bool)
    begin = np.flatnonzero(new)
    runs = np.diff(np.append(begin, len(k)))
    most = np.zeros(len(n), dtype=np.int64)
    np.maximum.at(most, doc[begin], runs)
    return np.where(n > 0, np.bincount(doc[begin], minlength=len(n)) / np.maximum(n, 1), 1.0), most / np.maximum(n, 1)


def features(column: pa.Array) -> np.ndarray:
    """A row of FEATURES for each whole text; null is empty."""
    raw, at = text_bytes(column)
    parts, begin = [], 0
    while begin < len(at) - 1:
        end = max(begin + 1, int(np.searchsorted(at, at[begin] + CHUNK, "right")) - 1)
        parts.append(_features(raw[at[begin] : at[end]], at[begin : end + 1] - at[begin]))
        begin = end
    return np.concatenate(parts) if parts else np.zeros((0, len(FEATURES)))


def _features(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    starts, ends, first = word_spans(raw, at)
    n_bytes, n_words = np.diff(at), np.diff(first)
    per = lambda x, y: x / np.maximum(y, 1)
    count = lambda table: _sums(table[raw], at)
    letters, marks, stops = count(LETTER), count(MARK), count(STOP)
    lines = count(LINE) + 1
    w = word_hashes(raw, starts, ends)
    distinct, top = _shares(w, first)
    threes = w[:-2] * np.uint64(3) + w[1:-1] * np.uint64(5) + w[2:] * np.uint64(7) if len(w) > 2 else np.zeros(0, np.uint64)
    within = np.arange(len(threes)) + 2 < np.repeat(first[1:], n_words)[: len(threes)]  # not over a text's end
    distinct3, _ = _shares(threes[within], np.concatenate([[0], np.cumsum(np.maximum(n_words - 2, 0))]))
    of_words = lambda flags: per(_sums(flags, first), n_words)
    has_letter = np.concatenate([[0], np.cumsum(LETTER[raw], dtype=np.int64)])
    letterless = has_letter[ends] == has_letter[starts]
    marked = ODD[raw[ends - 1]] | SHOUT[raw[ends - 1]] if len(ends) else np.zeros(0, bool)
    capital = UPPER[raw[starts]] if len(starts) else np.zeros(0, bool)
    # Lines by position-free hashes of their words, as sums.
    breaks = np.concatenate([[0], np.cumsum(LINE[raw], dtype=np.int64)])
    line_of = breaks[starts] + np.searchsorted(at, starts, "right") - 1 if len(starts) else np.zeros(0, np.int64)
    new = np.concatenate([[True], line_of[1:] != line_of[:-1]]) if len(line_of) else np.zeros(0, bool)
    head = np.flatnonzero(new)
    line_hash = np.add.reduceat(w, head) if len(head) else np.zeros(0, np.uint64)
    distinct_lines, _ = _shares(line_hash, np.searchsorted(head, first))
    return np.column_stack(
        [
            np.log1p(n_bytes), np.log1p(n_words), per(_sums(~np.isin(LOWER[raw], [9, 10, 11, 12, 13, 32]), at), n_words), per(count(UPPER), letters), per(count(DIGIT), n_bytes), per(marks, n_bytes), per(count(ODD), n_bytes), per(count(SHOUT), n_words),
            per(count(BAR), n_words), per(_sums(raw >= 128, at), n_bytes), distinct, top, distinct3, of_words(letterless), of_words(ends - starts <= 2), of_words(capital), per(n_words, stops), per(n_words, lines), distinct_lines, of_words(marked),
        ]
    )


@dataclass
class AdditiveModel:
    """Lookup tables: one of BINS for each feature, one of PAIR_BINS x PAIR_BINS for each pair."""

    edges: list = field(default_factory=list)
    coarse: list = field(default_factory=list)
    tables: np.ndarray | None = None
    pairs: list = field(default_factory=list)
    pair_tables: np.ndarray | None = None
    intercept: float = 0.0

    def binned(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        fine = np.column_stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.edges)]) if len(x) else np.zeros((0, len(self.edges)), np.int64)
        coarse = np.column_stack([np.searchsorted(e, x[:, f], "right") for f, e in enumerate(self.coarse)]) if len(x) else fine
        return fine, coarse

    def margin(self, x: np.ndarray) -> np.ndarray:
        """The sum of the tables' entries that each row falls into."""
        fine, coarse = self.binned(x)
        out = np.full(len(x), self.intercept) + self.tables[np.arange(len(self.edges)), fine].sum(axis=1)
        for (a, b), table in zip(self.pairs, self.pair_tables, strict=True):
            out += table[coarse[:, a], coarse[:, b]]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-np.clip(self.margin(x), -30, 30)))


def _tree(g: np.ndarray, h: np.ndarray, leaves: int = LEAVES, ridge: float = 5.0) -> np.ndarray:
    """Values of a small tree over bins: cuts that most reduce the loss, one after the other."""
    G, H = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    gain = lambda a, b: (G[b] - G[a]) ** 2 / (H[b] - H[a] + ridge)
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, None)
        for a, b in zip(cuts, cuts[1:], strict=False):
            if b - a > 1:
                c = np.arange(a + 1, b)
                won = gain(a, c) + gain(c, b) - gain(a, b)
                best = max(best, (float(won.max()), int(c[won.argmax()])), key=lambda t: t[0])
        if best[1] is None:
            break
        cuts = sorted([*cuts, best[1]])
    return np.concatenate([np.full(b - a, (G[b] - G[a]) / (H[b] - H[a] + ridge)) for a, b in zip(cuts, cuts[1:], strict=False)])


def _pair_tree(g: np.ndarray, h: np.ndarray, ridge: float = 5.0) -> tuple[np.ndarray, float]:
    """A cross of one cut on each axis with four leaves, and by how much it reduces the loss."""
    pad = lambda m: np.pad(m.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    G, H = pad(g), pad(h)
    n = len(g)
    i, j = (c.ravel() for c in np.meshgrid(np.arange(1, n), np.arange(1, n), indexing="ij"))
    quarter = lambda M: np.stack([M[i, j], M[i, n] - M[i, j], M[n, j] - M[i, j], M[n, n] - M[i, n] - M[n, j] + M[i, j]])
    a, b = quarter(G), quarter(H)
    won = (a**2 / (b + ridge)).sum(axis=0)
    k = int(won.argmax())
    leaf = a[:, k] / (b[:, k] + ridge)
    out = np.empty_like(g)
    out[: i[k], : j[k]], out[: i[k], j[k] :], out[i[k] :, : j[k]], out[i[k] :, j[k] :] = leaf
    return out, float(won[k])


def fit(x: np.ndarray, y: np.ndarray) -> AdditiveModel:
    """Boost one small tree for each feature in turn, round by round; then the pairs that most reduce what is left."""
    m = AdditiveModel()
    F_ = x.shape[1] if x.ndim == 2 else len(FEATURES)
    cuts = lambda f, k: np.unique(np.quantile(x[:, f], np.linspace(0, 1, k + 1)[1:-1])) if len(x) else np.zeros(0)
    m.edges, m.coarse = [cuts(f, BINS) for f in range(F_)], [cuts(f, PAIR_BINS) for f in range(F_)]
    m.tables = np.zeros((F_, BINS))
    m.pair_tables = np.zeros((0, PAIR_BINS, PAIR_BINS))
    share = (y.sum() + 1.0) / (len(y) + 2.0)
    m.intercept = float(np.log(share / (1 - share)))
    if not len(y) or y.min() == y.max():
        return m
    fine, coarse = m.binned(x)
    margin = np.full(len(y), m.intercept)

    def slope():
        p = 1 / (1 + np.exp(-margin))
        return y - p, np.maximum(p * (1 - p), 1e-6)

    for _ in range(ROUNDS):
        for f in range(F_):
            g, h = slope()
            step = RATE * _tree(np.bincount(fine[:, f], g, BINS), np.bincount(fine[:, f], h, BINS))
            m.tables[f] += step
            margin += step[fine[:, f]]
    cell = lambda a, b: coarse[:, a] * PAIR_BINS + coarse[:, b]
    grid = lambda c, v: np.bincount(c, v, PAIR_BINS**2).reshape(PAIR_BINS, PAIR_BINS)
    g, h = slope()
    ranked = sorted(((_pair_tree(grid(cell(a, b), g), grid(cell(a, b), h))[1], a, b) for a in range(F_) for b in range(a + 1, F_)), reverse=True)
    m.pairs = [(a, b) for _, a, b in ranked[:PAIRS]]
    m.pair_tables = np.zeros((len(m.pairs), PAIR_BINS, PAIR_BINS))
    cells = [cell(a, b) for a, b in m.pairs]
    for _ in range(PAIR_ROUNDS):
        for k, c in enumerate(cells):
            g, h = slope()
            step = RATE * _pair_tree(grid(c, g), grid(c, h))[0]
            m.pair_tables[k] += step
            margin += step.ravel()[c]
    return m


def remainder(name: str = "doc_id"):
    """crc32(doc_id as text) mod 5; a null doc_id counts as empty text."""
    return F.crc32(F.coalesce(F.col(name).cast("string"), F.lit("")).cast("binary")) % 5


def train(docs: DataFrame, labels: DataFrame) -> AdditiveModel:
    """The model of labelled documents whose remainder() isn't 0: all, or about TRAIN_ROWS that a hash of doc_id picks from the whole table.

    Of rows that repeat a doc_id one is learned from, by a hash of its text, so that no doc_id can
    fill the driver. ``labels`` has doc_id and quality (0 or 1; rows of null are left out). Without labels, or with
    labels all alike, every text gets the share of label 1 (a half without labels).
    """
    bound_batches(docs.sparkSession)
    known = labels.where("quality is not null and doc_id is not null").groupBy("doc_id").agg(F.max("quality").alias("quality")).where(remainder() != 0)
    n = known.count()
    if n > TRAIN_ROWS:
        known = known.where(F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) < int((1 << 30) * TRAIN_ROWS / n))
    known = F.broadcast(known.select("doc_id", F.col("quality").cast("int").alias("quality")))  # TRAIN_ROWS rows, about

    def run(batches):
        for b in batches:
            x = features(b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("version"), b.column("quality"), pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))], names=["doc_id", "version", "quality", "x"])

    made = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("version"), "text").join(known, "doc_id").mapInArrow(tidy(run), "doc_id long, version long, quality int, x array<double>")
    rows = made.groupBy("doc_id").agg(F.min_by(F.struct("quality", "x"), "version").alias("r")).select("doc_id", "r.*").toPandas().sort_values("doc_id", kind="stable")
    x = np.array(rows["x"].tolist(), dtype=np.float64).reshape(len(rows), len(FEATURES))
    order = np.lexsort((*x.T, rows["doc_id"].to_numpy()))
    return fit(x[order], rows["quality"].to_numpy(dtype=np.float64)[order])


def keep(docs: DataFrame, model: AdditiveModel, threshold: float = 0.3) -> DataFrame:
    """The rows of ``docs``, whatever its columns, whose text scores ``threshold`` or more; null texts are empty, repeated rows are judged each."""
    bound_batches(docs.sparkSession)
    at = docs.columns.index("text")

    def run(batches):
        for b in batches:
            yield b.filter(pa.array(model.score(features(b.column(at))) >= threshold))

    return docs.mapInArrow(tidy(run), docs.schema)


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of ``docs`` (doc_id, text, any more columns), by a model of ``labels``.

    A row's remainder() 0 holds it out of learning. Features are counted over whole texts, however
    long. Null texts are empty, and an empty text has a score by its features like any other. Each
    row is scored by its own text, also where a doc_id repeats or is null; equal texts score alike.
    In learning, one row of a labelled doc_id counts, and of its several labels the largest. An empty table gives no rows.
    """
    model = train(docs, labels)

    def run(batches):
        for b in batches:
            p = model.score(features(b.column(1)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=["doc_id", "score", "predicted"])

    bound_batches(docs.sparkSession)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, score double, predicted int")
    return scored.select("doc_id", (remainder() == 0).alias("held_out"), "score", "predicted")
