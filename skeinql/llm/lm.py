"""LM scoring: prediction by partial matching over bytes, trained on the corpus.

Counts over byte contexts up to ORDER bytes long tell how often each byte followed each context in
the training documents, all of them counted. A byte is predicted from its longest context; a byte
not seen there escapes to the next shorter context (method C: the number of different bytes seen
weighs as the escape's count), with the bytes of the context it left excluded. Below the empty
context every byte not seen is alike. A document is its tokens (A-Z in lower case) joined by blanks,
then a line feed as its end, so the score is the log10 probability of what the base score also rates.

Nothing is left out, however large the corpus: a gram of the longest context that training has seen has
its log in a table, which documents meet in a join; the CACHE most frequent go with every task. A gram
not seen there needs its shorter contexts: all grams that agree in the last ROUTE bytes of their
context lie in one shard, which with the counts of the orders below ROUTE makes a trie of its own (at
most 256^(ORDER - ROUTE + 1) grams for one such context, and 256^ROUTE grams sent along). Token counts
likewise: the DICTIONARY most frequent go with every task, all others meet their counts in a join.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ._shared import appended, id_text, stored, table

ORDER = 5
ROUTE = 3
CACHE, DICTIONARY = 1 << 20, 1 << 16
#: Grams that a shard is planned for.
SHARD = 1 << 20
END = b"\n"
#: Different tokens and grams that a training task holds before it passes its counts on, and bytes
#: that are counted or scored at once.
HELD_TOKENS, HELD_GRAMS, HELD_BYTES = 1 << 18, 1 << 20, 1 << 21


def tokens(text: str | None) -> list[bytes]:
    return [*text.encode().lower().split(), END] if text else [END]


def held_out(doc_id: int | None) -> bool:
    """A null doc_id counts as the empty text, whose remainder is 0."""
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 10 == 0


def token_hash(tokens_: Iterable[bytes]) -> np.ndarray:
    """64 bits stand for a token: of 10^8 different ones, two agree with a chance of about 3 in 10,000."""
    import xxhash

    return np.array([xxhash.xxh64_intdigest(t) for t in tokens_], np.uint64).view(np.int64)


def grams(data: bytes, order: int) -> np.ndarray:
    """Each byte of the documents in data (each ends with END) with the `order` bytes before it, as
    one number. What stands before a document's first byte is END and nothing else."""
    x = np.frombuffer(data, np.uint8)
    end = ord(END)
    n = np.arange(len(x))
    # The place of the last document's end before each byte.
    last = np.maximum.accumulate(np.where(np.concatenate([[True], x[:-1] == end]), n, 0)) if len(x) else n
    out = x.astype(np.uint64)
    for k in range(1, order + 1):
        before = np.full(len(x), end, np.uint64)
        before[k:] = x[:-k] if k < len(x) else 0
        before[n - k < last] = end
        out |= before << np.uint64(8 * k)
    return out


class Trie:
    """Log10 probabilities of PPM with escapes and exclusion, from counts of grams by order."""

    def __init__(self, counts: list[tuple[np.ndarray, np.ndarray]]):
        """counts[k]: grams of k + 1 bytes and how often each occurs; sorted, and complete for each
        context that they have."""
        self.order = len(counts) - 1
        keys, values, self.contexts, self.total, self.kinds = [], [], [], [], []
        for codes, n in counts:
            ctx, at = np.unique(codes >> np.uint64(8), return_inverse=True)
            self.contexts.append(ctx)
            self.total.append(np.bincount(at, n, len(ctx)))
            self.kinds.append(np.bincount(at, minlength=len(ctx)).astype(float))
        self.codes, self.n = [c for c, _ in counts], [n.astype(float) for _, n in counts]
        # below[k]: for each context of order k, the weight at order k - 1 of bytes it hasn't, escape included.
        self.below: list[np.ndarray] = [np.zeros(0)]
        for k in range(1, self.order + 1):
            shorter = self.codes[k] & np.uint64((1 << 8 * k) - 1)
            seen = self.n[k - 1][np.searchsorted(self.codes[k - 1], shorter)]
            at = np.searchsorted(self.contexts[k], self.codes[k] >> np.uint64(8))
            up = np.searchsorted(self.contexts[k - 1], self._shorter(self.contexts[k], k))
            rest = self.total[k - 1][up] - np.bincount(at, seen, len(self.contexts[k]))
            self.below.append(rest + self.kinds[k - 1][up] - self.kinds[k])

    @staticmethod
    def _shorter(ctx: np.ndarray, order: int) -> np.ndarray:
        return ctx & np.uint64((1 << 8 * (order - 1)) - 1)

    @staticmethod
    def _find(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
        if not len(sorted_):
            return np.full(len(x), -1)
        at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
        return np.where(sorted_[at] == x, at, -1)

    def logs(self, codes: np.ndarray) -> np.ndarray:
        """Log10 probability of each gram's last byte after the bytes before it."""
        kinds, back = np.unique(codes, return_inverse=True)
        return self._escaped(kinds)[back]

    def _escaped(self, codes: np.ndarray) -> np.ndarray:
        """Of different grams, from the longest context down."""
        out, weight = np.zeros(len(codes)), np.full(len(codes), np.nan)
        left = np.arange(len(codes))
        over = np.zeros(len(codes))  # bytes excluded
        for k in range(self.order, -1, -1):
            c = codes[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            ctx, sym = self._find(self.contexts[k], c >> np.uint64(8)), self._find(self.codes[k], c)
            w = np.where(np.isnan(weight[left]), (self.total[k] + self.kinds[k])[ctx], weight[left]) if len(self.contexts[k]) else weight[left]
            known = ctx >= 0
            hit = sym >= 0
            out[left[hit]] += np.log10(self.n[k][sym[hit]] / w[hit])
            miss = known & ~hit
            fresh = (self.kinds[k][ctx] - over[left] if len(self.contexts[k]) else over[left])[miss]
            escape = fresh > 0  # a context with nothing but excluded bytes is passed over
            out[left[miss][escape]] += np.log10(fresh[escape] / w[miss][escape])
            m = left[miss]
            over[m] = self.kinds[k][ctx[miss]]
            weight[m] = self.below[k][ctx[miss]] if k else np.nan
            left = left[~hit]
        out[left] += -np.log10(256 - over[left])
        return out


class Known:
    """Logs of some grams, found by open addressing at a load of a quarter or less."""

    MIX = np.uint64(0x9E3779B97F4A7C15)

    def __init__(self, codes: np.ndarray, logs: np.ndarray):
        self.codes, self.logs = codes, logs
        bits = max(4, int(np.ceil(np.log2(max(1, len(codes)) * 4))))
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.slot = np.full(1 << bits, -1, np.int32)
        left = np.arange(len(codes))
        at = ((codes * self.MIX) >> self.shift).astype(np.int64)
        while len(left):
            free = self.slot[at] < 0
            self.slot[at[free]] = left[free]
            lost = self.slot[at] != left
            left, at = left[lost], (at[lost] + 1) & self.mask

    def find(self, codes: np.ndarray) -> np.ndarray:
        """Where each gram is, or -1."""
        if not len(self.codes):
            return np.full(len(codes), -1)
        at = ((codes * self.MIX) >> self.shift).astype(np.int64)
        out = self.slot[at].astype(np.int64)
        left = np.flatnonzero((out >= 0) & (self.codes[out] != codes))
        while len(left):
            at[left] = (at[left] + 1) & self.mask
            out[left] = self.slot[at[left]]
            left = left[(out[left] >= 0) & (self.codes[out[left]] != codes[left])]
        return out

    def score(self, data: list[bytes], order: int) -> tuple[np.ndarray, list[np.ndarray], list[np.ndarray]]:
        """Of documents, each ending with END: the sum of the logs known, the grams that aren't, and how
        often each occurs."""
        if not data:
            return np.zeros(0), [], []
        ends = np.cumsum([len(d) for d in data])
        codes = grams(b"".join(data), order)
        at = self.find(codes)
        logs = np.where(at >= 0, self.logs[at], 0.0) if len(self.logs) else np.zeros(len(codes))
        gone = np.flatnonzero(at < 0)
        whose, codes = np.searchsorted(ends, gone, "right"), codes[gone]
        by = np.lexsort((codes, whose))
        whose, codes = whose[by], codes[by]
        first = np.flatnonzero(np.concatenate([[True], (whose[1:] != whose[:-1]) | (codes[1:] != codes[:-1])])) if len(by) else by
        n = np.diff(np.concatenate([first, [len(by)]]))
        cut = np.searchsorted(whose[first], np.arange(1, len(data)))
        return np.add.reduceat(logs, np.concatenate([[0], ends[:-1]])), np.split(codes[first].view(np.int64), cut), np.split(n, cut)


def train_counts(docs: DataFrame, order: int) -> tuple[DataFrame, DataFrame]:
    """(h, n): counts of tokens; (g, n): counts of grams; over the training documents, stored."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: Counter[bytes] = Counter()
        data: list[bytes] = []
        size = 0
        held: tuple[np.ndarray, np.ndarray] = (np.zeros(0, np.uint64), np.zeros(0, np.int64))

        def rows(gram: bool, k: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(k), gram)), pa.array(k.view(np.int64)), pa.array(n)], ["gram", "k", "n"])

        def merged() -> tuple[np.ndarray, np.ndarray]:
            k, n = np.unique(grams(b"".join(data), order), return_counts=True)
            data.clear()
            both, at = np.unique(np.concatenate([held[0], k]), return_inverse=True)
            return both, np.bincount(at, np.concatenate([held[1], n]), len(both)).astype(np.int64)

        for b in batches:
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if held_out(doc_id):
                    continue
                own = tokens(text.as_py())
                words.update(own)
                data.append(b" ".join(own[:-1]) + END)
                size += len(data[-1])
                if len(words) >= HELD_TOKENS:
                    yield rows(False, token_hash(words), np.fromiter(words.values(), np.int64, len(words)))
                    words.clear()
                if size >= HELD_BYTES:
                    held, size = merged(), 0
                    if len(held[0]) >= HELD_GRAMS:
                        yield rows(True, *held)
                        held = held[0][:0], held[1][:0]
        yield rows(False, token_hash(words), np.fromiter(words.values(), np.int64, len(words)))
        yield rows(True, *merged())

    counted = stored(docs.mapInArrow(run, "gram boolean, k long, n long").groupBy("gram", "k").agg(F.sum("n").alias("n")), "counts")
    return counted.filter("not gram").select(F.col("k").alias("h"), "n"), counted.filter("gram").select(F.col("k").alias("g"), "n")


def frequent(counts: DataFrame, most: int) -> Column:
    """The condition that at most so many rows of counts, those of the largest n, meet."""
    step = F.floor(F.log2("n") * 16)
    room, least = most, 1 << 16
    for r in sorted(counts.groupBy(step.alias("step")).agg(F.count("*").alias("rows")).collect(), reverse=True):
        if r.rows > room:
            break
        room, least = room - r.rows, r.step
    return step >= least


def low_orders(counts: DataFrame, orders: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Counts of all grams of the first orders: at most 256^orders."""
    out = []
    for k in range(orders):
        t = counts.groupBy(F.col("g").bitwiseAND((1 << 8 * (k + 1)) - 1).alias("g")).agg(F.sum("n").alias("n")).toArrow()
        codes, n = t["g"].to_numpy().astype(np.uint64), t["n"].to_numpy().astype(np.int64)
        at = np.argsort(codes)
        out.append((codes[at], n[at]))
    return out


def trie(low: list[tuple[np.ndarray, np.ndarray]], codes: np.ndarray, n: np.ndarray, order: int) -> Trie:
    """Of the low orders and the longest grams, complete for each of their contexts of len(low) bytes."""
    levels = []
    for k in range(order, len(low) - 1, -1):
        codes, at = np.unique(codes & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
        n = np.bincount(at, n, len(codes)).astype(np.int64)
        levels.append((codes, n))
    return Trie([*low, *levels[::-1]])


def unseen_logs(counts: DataFrame, unseen: DataFrame, order: int, route: int, shard: int) -> DataFrame:
    """(g, log) of grams (g, different ones) that counts hasn't."""
    route = min(route, order)
    low = counts.sparkSession.sparkContext.broadcast(low_orders(counts, route))
    end = F.shiftright("g", 8).bitwiseAND((1 << 8 * route) - 1).alias("end")
    near = counts.select(end, "g", "n").join(unseen.select(end).distinct(), "end", "left_semi")
    number = max(1, -(-counts.count() // shard))
    group = F.pmod(F.xxhash64("end"), F.lit(number)).alias("shard")

    def score(seen: pa.Table, asked: pa.Table) -> pa.Table:
        g = asked["g"].to_numpy()
        made = trie(low.value, seen["g"].to_numpy().astype(np.uint64), seen["n"].to_numpy(), order) if len(g) else None
        return pa.table({"g": g, "log": made.logs(g.astype(np.uint64)) if made else np.zeros(0)})

    return near.groupBy(group).cogroup(unseen.select(end, "g").groupBy(group)).applyInArrow(score, "g long, log double")


_known: dict[int, Known] = {}


def base_log(c: Column, n: int, v: int) -> Column:
    return F.log10((c + F.lit(0.1)) / F.lit(n + 0.1 * (v + 1)))


def scores(docs: DataFrame, order: int = ORDER, route: int = ROUTE, cache: int = CACHE, dictionary: int = DICTIONARY, shard: int = SHARD) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for each row of docs.

    A null or empty text is its end alone; equal rows count and score each for itself. Without any
    training document N and V are 0, no token is known, and every byte is as likely as any other. cache,
    dictionary and shard change no score.
    """
    docs = id_text(docs)
    sc = docs.sparkSession.sparkContext
    token_counts, gram_counts = train_counts(docs, order)
    total = token_counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    common = dict(token_counts.filter(frequent(token_counts, dictionary)).collect())
    context = Window.partitionBy(F.shiftright("g", 8))  # at most 256 rows
    gram_logs = stored(gram_counts.select("g", "n", F.log10(F.col("n") / (F.sum("n").over(context) + F.count("*").over(context))).alias("log")), "logs")
    sent = gram_logs.filter(frequent(gram_logs, cache)).select("g", "log").toArrow()
    model = sc.broadcast((sent["g"].to_numpy().astype(np.uint64), sent["log"].to_numpy(), np.array(sorted(common), np.int64), np.array([common[h] for h in sorted(common)], np.int64)))
    number, kinds = int(total[0]), int(total[1])

    def start() -> Callable[[list], list[list]]:
        codes, logs_, hashes, n = model.value
        if id(codes) not in _known:
            _known.clear()
            _known[id(codes)] = Known(codes, logs_)
        table_ = _known[id(codes)]
        known = dict(zip(hashes.tolist(), n.tolist(), strict=True))
        logs = {h: float(np.log10((c + 0.1) / (number + 0.1 * (kinds + 1)))) for h, c in known.items()}

        def make(texts: list) -> list[list]:
            out: list[list] = [[], [], [], [], [], [], [], []]
            data, size = [], 0

            def flush() -> None:
                nonlocal data, size
                for col, v in zip(out[5:], table_.score(data, order), strict=True):
                    col.extend(v)
                data, size = [], 0

            for text in texts:
                own = tokens(text)
                data.append(b" ".join(own[:-1]) + END)
                size += len(data[-1])
                tf = Counter(own)
                n_known, base, rest, rest_n = 0, 0.0, [], []
                for h, c in zip(token_hash(tf).tolist(), tf.values(), strict=True):
                    log = logs.get(h)
                    if log is None:
                        rest.append(h)
                        rest_n.append(c)
                    else:
                        n_known += c
                        base += c * log
                for col, v in zip(out, (len(own), n_known, base, rest, rest_n), strict=False):
                    col.append(v)
                if size >= HELD_BYTES:
                    flush()
            flush()
            return out

        return make

    first = appended(docs, "text", "_n long, _known long, _base double, _rest array<long>, _tf array<long>, _score double, _grams array<long>, _times array<long>", start, keep=False)
    first = stored(first.withColumn("_row", F.monotonically_increasing_id()), "scored")
    rest = first.select("_row", F.explode(F.arrays_zip(F.col("_rest").alias("h"), F.col("_tf").alias("tf"))).alias("x")).select("_row", "x.h", "x.tf")
    c = F.coalesce(F.col("n"), F.lit(0))
    met = rest.join(token_counts, "h", "left").groupBy("_row").agg(F.sum(F.when(c > 0, F.col("tf")).otherwise(0)).alias("known"), F.sum(F.col("tf") * base_log(c, number, kinds)).alias("base"))
    left = first.select("_row", F.explode(F.arrays_zip(F.col("_grams").alias("g"), F.col("_times").alias("times"))).alias("x")).select("_row", "x.g", "x.times")
    unseen = stored(left.select("g").distinct().join(gram_logs, "g", "left_anti"), "unseen")
    every = gram_logs.select("g", "log").unionByName(stored(unseen_logs(gram_counts, unseen, order, route, shard), "unseen_logs"))
    rare = left.join(every, "g").groupBy("_row").agg(F.sum(F.col("times") * F.col("log")).alias("rare"))
    out_of = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(10)) == 0
    return (
        first.drop("_rest", "_tf", "_grams", "_times")
        .join(met, "_row", "left")
        .join(rare, "_row", "left")
        .select(
            "doc_id",
            out_of.alias("held_out"),
            F.col("_n").alias("n_tokens"),
            (F.col("_known") + F.coalesce("known", F.lit(0))).cast("long").alias("n_known"),
            F.lit(number).cast("long").alias("train_tokens"),
            (F.col("_base") + F.coalesce("base", F.lit(0.0))).alias("base_score"),
            (F.col("_score") + F.coalesce("rare", F.lit(0.0))).alias("score"),
        )
    )


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(table(spark, sf_dir, "documents"))
