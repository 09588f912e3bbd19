"""Language-model scores by context-tree weighting over bytes, beside a unigram base."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.scale import checkpointed
from .batches import LOWER, id_and_text, raw, slices, task_id

#: Bytes of context.
DEPTH = 5

#: The tree is cut here: nodes of contexts shorter than this are few and known to every task; a longer
#: context's nodes are made, and asked, in the task that has all counts of its nearest bytes.
SPLIT = 3

#: Bytes that are scored from a broadcast, with their contexts, at most; the others are looked up by a join.
FREQUENT_GRAMS = 1 << 20

#: Rows of counts that a task turns into nodes at a time.
CHUNK_ROWS = 1 << 18

#: Tokens of at least this share of all training tokens go to the tasks in a broadcast: at most 2**20 tokens.
TOKEN_SHARE = 2.0**-20

#: Ends a text in the tree and pads the context before its start.
END = b"\0"

#: The end of a text as a token; no word holds a space.
END_TOKEN = b" end"

_COUNT = pa.schema([("kind", pa.int32()), ("key", pa.int64()), ("n", pa.int64())])
_TOKEN, _BYTES = 0, 1


def words_of(text: bytes) -> list[bytes]:
    return text.translate(LOWER).split()


def _signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def token_key(token: bytes) -> int:
    return _signed(xxhash.xxh3_64_intdigest(token))


def _windows(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    """All texts in one array, each behind ``depth`` pads, and which bytes are their own."""
    joined = np.frombuffer(b"".join(END * depth + t for t in texts), np.uint8)
    own = np.ones(len(joined), bool)
    starts = np.cumsum([0, *(len(t) + depth for t in texts[:-1])])
    for i in range(depth):
        own[starts + i] = False
    return joined, own


def _keys(texts: list[bytes], depth: int) -> np.ndarray:
    """Each byte below the ``depth`` bytes before it, the nearest lowest, as one number."""
    joined, own = _windows(texts, depth)
    # the eight bytes up to each place, read as one number
    whole = np.ndarray(len(joined), ">u8", np.r_[np.zeros(7, np.uint8), joined], strides=(1,))
    return whole[own].astype(np.uint64) & np.uint64((1 << 8 * (depth + 1)) - 1)


def _grams(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray]:
    return np.unique(_keys(texts, depth), return_counts=True)


def _counted(depth: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens: Counter = Counter()
        grams = [(np.empty(0, np.uint64), np.empty(0, np.int64))]

        def merge() -> None:
            keys = np.concatenate([k for k, _ in grams])
            order = np.argsort(keys, kind="stable")  # quick on parts that are sorted
            keys = keys[order]
            starts = np.flatnonzero(np.r_[True, keys[1:] != keys[:-1]][: len(keys)])
            grams[:] = [(keys[starts], np.add.reduceat(np.concatenate([n for _, n in grams])[order], starts) if len(starts) else np.empty(0, np.int64))]

        def send(kind: int, keys, counts) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(keys), kind, np.int32)), pa.array(keys, pa.int64()), pa.array(counts, pa.int64())], schema=_COUNT)

        def words() -> Iterator[pa.RecordBatch]:
            yield send(_TOKEN, list(map(token_key, tokens)), list(tokens.values()))
            tokens.clear()

        for batch in slices(batches):
            texts, held = [], 0
            for text in raw(batch.column("text")):
                own = words_of(text)
                tokens.update(own)
                tokens[END_TOKEN] += 1
                texts.append(b" ".join(own) + END)
                held += len(texts[-1])
                if held > 2 << 20:
                    grams.append(_grams(texts, depth))
                    texts, held = [], 0
            if texts:
                grams.append(_grams(texts, depth))
            if sum(len(k) for k, _ in grams) > 2_000_000:
                merge()
                if len(grams[0][0]) > 1_000_000:
                    yield send(_BYTES, *(x.astype(np.int64) for x in grams.pop()))
            if len(tokens) > 400_000:
                yield from words()
        if grams:
            merge()
            yield send(_BYTES, *(x.astype(np.int64) for x in grams[0]))
        yield from words()

    return run


def log_gamma(x: np.ndarray) -> np.ndarray:
    """ln of the gamma function for x > 0, by Stirling's series at x + 8."""
    y = x + 8.0
    series = 1 / (12 * y) - 1 / (360 * y**3) + 1 / (1260 * y**5) - 1 / (1680 * y**7)
    down = sum(np.log(x + i) for i in range(8))
    return (y - 0.5) * np.log(y) - y + 0.5 * np.log(2 * np.pi) + series - down


def _bits(counts: np.ndarray) -> np.ndarray:
    """Counts of the 256 bytes, summed up their binary tree: column m has children 2m and 2m + 1."""
    tree = np.zeros((len(counts), 512))
    tree[:, 256:] = counts
    for m in range(255, 0, -1):
        tree[:, m] = tree[:, 2 * m] + tree[:, 2 * m + 1]
    return tree


def _estimates(counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of the 255 decisions: ln of the Krichevsky-Trofimov probability of the counts, and that of a next 1."""
    block, following = np.empty((len(counts), 255)), np.empty((len(counts), 255), np.float32)
    for at in range(0, len(counts), 1024):  # small pieces keep the driver's memory small
        tree = _bits(counts[at : at + 1024])
        zero, one = tree[:, 2:512:2], tree[:, 3:512:2]
        block[at : at + 1024] = log_gamma(zero + 0.5) + log_gamma(one + 0.5) - log_gamma(zero + one + 1) - np.log(np.pi)
        following[at : at + 1024] = (one + 0.5) / (zero + one + 1)
    return block, following


@dataclass(frozen=True)
class Tree:
    """``step[s, b]`` is the state after context byte ``b``; states from ``len(step)`` on are leaves, each with
    log10 of the probability of every next byte."""

    step: np.ndarray
    logs: np.ndarray
    depth: int

    def scores(self, texts: list[bytes]) -> np.ndarray:
        """log10 of each text's probability; the texts are not empty."""
        joined, own = _windows(texts, self.depth)
        places = np.flatnonzero(own)
        inner, step, logs = len(self.step), self.step.ravel(), self.logs.ravel()
        state = np.zeros(len(places), np.int32)
        for i in range(1, self.depth + 1):
            after = step[np.minimum(state, inner - 1) * np.int32(256) + joined[places - i]]
            state = np.where(state < inner, after, state)
        each = logs[(state - np.int32(inner)) * np.int32(256) + joined[places]]
        return np.add.reduceat(each.astype(np.float64), np.cumsum([0, *map(len, texts[:-1])]))


#: Of one decision of a byte and one depth, sorted by number: the nodes that have counts, their probability of a
#: next 1, and the weight of stopping there. A node's number is its context, the nearest byte highest, and
#: the bits of the byte so far.
Nodes = tuple[np.ndarray, np.ndarray, np.ndarray]


def _split_keys(keys: np.ndarray, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """Contexts, the nearest byte highest, and bytes of keys."""
    contexts = np.zeros(len(keys), np.int64)
    for i in range(1, depth + 1):
        contexts = contexts << 8 | (keys >> 8 * i & 255)
    return contexts, keys & 255


def _folded(ids: np.ndarray, *values: np.ndarray) -> list[np.ndarray]:
    """The distinct ids, and the sums of their values."""
    ids, at = np.unique(ids, return_inverse=True)
    return [ids, *(np.bincount(at, v, len(ids)) for v in values)]


def _climbed(j: int, state: list[np.ndarray | None], deepest: int, top: int) -> tuple[list[Nodes], list[np.ndarray | None]]:
    """Nodes of decision ``j`` from depth ``deepest`` up to ``top``, the topmost first, and the state one depth higher.

    A state is the numbers of nodes, their counts of 0 and 1, and the sum of ln of their children's weighted
    probabilities, or None where nodes have no children.
    """
    found = []
    for _ in range(deepest, top - 1, -1):
        ids, zero, one, below = state
        block = log_gamma(zero + 0.5) + log_gamma(one + 0.5) - log_gamma(zero + one + 1) - np.log(np.pi)
        stop = np.ones(len(ids)) if below is None else 1 / (1 + np.exp(np.clip(below - block, -700, 700)))
        found.append((ids, (one + 0.5) / (zero + one + 1), stop))
        both = block if below is None else np.logaddexp(block, below) - np.log(2)
        state = _folded((ids >> 8 + j) << j | (ids & (1 << j) - 1), zero, one, both)
    return found[::-1], state


def _grown(keys: np.ndarray, counts: np.ndarray, depth: int, top: int) -> list[tuple[list[Nodes], list]]:
    """``_climbed`` from the counts of whole keys, for each of a byte's eight decisions."""
    contexts, symbols = _split_keys(keys, depth)
    found = []
    for j in range(8):
        ids, zero, one = _folded(contexts << j | symbols >> 8 - j, *(counts * ((symbols >> 7 - j & 1) == bit) for bit in (0, 1)))
        found.append(_climbed(j, [ids, zero, one, None], depth, top))
    return found


def _logs(levels: list[list[Nodes]], keys: np.ndarray, depth: int) -> np.ndarray:
    """log10 of the probability of each key's byte after its context; where no node is, a bit has 1/2."""
    contexts, symbols = _split_keys(keys, depth)
    logs = np.zeros(len(keys))
    for j, nodes in enumerate(levels):
        one, left = np.zeros(len(keys)), np.ones(len(keys))
        for d, (ids, following, stop) in enumerate(nodes):
            if not len(ids):
                continue
            wanted = (contexts >> 8 * (depth - d)) << j | symbols >> 8 - j
            at = np.minimum(np.searchsorted(ids, wanted), len(ids) - 1)
            hit = ids[at] == wanted
            share = left * np.where(hit, stop[at], 0.0)
            one += share * following[at]
            left -= share
        one += left / 2
        logs += np.log10(np.where(symbols >> 7 - j & 1, one, 1 - one))
    return logs


def _whole_chunks(batches: Iterator[pa.RecordBatch], least: int) -> Iterator[list[np.ndarray]]:
    """``key, n, asked`` of batches sorted by ``at``, in pieces of some ``least`` rows that never part an ``at``."""
    held, n, limit = [], 0, least
    for batch in batches:
        held.append(batch)
        n += batch.num_rows
        if n < limit:
            continue
        table = pa.Table.from_batches(held)
        at = table.column("at").to_numpy()
        cut = int(np.searchsorted(at, at[-1]))
        if cut:
            yield [table.column(c).slice(0, cut).to_numpy() for c in ("key", "n", "asked")]
        held = table.slice(cut).to_batches()
        n -= cut
        limit = max(least, 2 * n)
    if n:
        yield [pa.Table.from_batches(held).column(c).to_numpy() for c in ("key", "n", "asked")]


def _dealt(rows: DataFrame, depth: int) -> DataFrame:
    """``key, n, asked`` with all rows of the same ``SPLIT`` nearest bytes together."""
    at = F.shiftright("key", 8).bitwiseAND((1 << 8 * min(SPLIT, depth)) - 1).alias("at")
    return rows.select(at, "key", "n", "asked").repartition("at").sortWithinPartitions("at")


_UP = pa.schema([("j", pa.int32()), ("id", pa.int64()), ("zero", pa.float64()), ("one", pa.float64()), ("below", pa.float64())])


def _rolled_up(depth: int, chunk: int):
    """What the nodes of a chunk add to the nodes one depth above the split."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts, _ in _whole_chunks(batches, chunk):
            for j, (_, state) in enumerate(_grown(keys, counts, depth, min(SPLIT, depth))):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(state[0]), j, np.int32)), *map(pa.array, state)], schema=_UP)

    return run


_LOG = pa.schema([("key", pa.int64()), ("log", pa.float64())])


def _asked(top, depth: int, chunk: int):
    """The logs of the asked keys of a chunk, from its nodes and those above the split in the broadcast ``top``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for keys, counts, asked in _whole_chunks(batches, chunk):
            wanted = keys[asked]
            if not len(wanted):
                continue
            seen = counts > 0
            below = _grown(keys[seen], counts[seen], depth, min(SPLIT, depth))
            logs = _logs([[*upper, *lower] for upper, (lower, _) in zip(top.value, below, strict=True)], wanted, depth)
            yield pa.RecordBatch.from_arrays([pa.array(wanted), pa.array(logs)], schema=_LOG)

    return run


def weighted(depths: np.ndarray, contexts: np.ndarray, symbols: np.ndarray, counts: np.ndarray, depth: int) -> Tree:
    """The weighted tree of the kept contexts, from (depth, context, byte, count) of each, in one process.

    For small tables; ``fit`` and ``score`` give what this gives when all contexts are kept.
    A node with children has one more child, a leaf for all contexts that were not kept. Going up, a node's
    weighted probability is half its own estimate and half the product of its children's; going down,
    that gives every leaf the mixture over all depths of its path.
    """
    levels = []
    for d in range(depth + 1):
        own = depths == d
        keys, at = np.unique(contexts[own], return_inverse=True)
        table = np.zeros((len(keys), 256))
        np.add.at(table, (at, symbols[own]), counts[own])
        levels.append((keys, table))
    if not len(levels[0][0]):
        levels = [(np.zeros(1, np.int64), np.zeros((1, 256)))] + [(np.empty(0, np.int64), np.empty((0, 256)))] * depth
    parents = [None] + [np.searchsorted(levels[d - 1][0], levels[d][0] & ((1 << 8 * (d - 1)) - 1)) for d in range(1, depth + 1)]

    stop, kt, rest_kt = [None] * depth, [None] * (depth + 1), [None] * depth
    below, kt[depth] = _estimates(levels[depth][1])
    for d in range(depth - 1, -1, -1):
        _, table = levels[d]
        rest = table.copy()
        np.subtract.at(rest, parents[d + 1], levels[d + 1][1])
        levels[d + 1] = levels[d + 1][0], None
        children, rest_kt[d] = _estimates(rest)
        np.add.at(children, parents[d + 1], below)
        block, kt[d] = _estimates(table)
        stop[d] = (1 / (1 + np.exp(np.clip(children - block, -700, 700)))).astype(np.float32)
        below = np.logaddexp(block, children, out=children)
        below -= np.log(2)
    del below, children, block, rest

    bases = np.cumsum([0, *(len(levels[d][0]) for d in range(depth))])
    inner = int(bases[-1])
    step = np.empty((inner, 256), np.int32)
    mixed = np.zeros((1, 255), np.float32), np.ones((1, 255), np.float32)
    leaves = []
    for d in range(depth):
        n = len(levels[d][0])
        if d:
            mixed = tuple(x[parents[d]] for x in mixed)
        share = mixed[1] * stop[d]
        mixed = mixed[0] + share * kt[d], mixed[1] - share
        step[bases[d] : bases[d] + n] = inner + bases[d] + np.arange(n)[:, None]
        leaves.append(mixed[0] + mixed[1] * rest_kt[d])
        keys = levels[d + 1][0]
        first = bases[d + 1] if d + 1 < depth else 2 * inner
        step[bases[d] + parents[d + 1], keys >> 8 * d] = first + np.arange(len(keys))
    last = tuple(x[parents[depth]] for x in mixed)
    leaves.append(last[0] + last[1] * kt[depth])

    one = np.concatenate(leaves)
    del leaves, mixed, last
    logs = np.zeros((len(one), 256), np.float32)
    for width in (128, 64, 32, 16, 8, 4, 2, 1):  # the decisions of a byte, from the last bit to the first
        now = np.log10(np.stack([1 - one[:, width - 1 : 2 * width - 1], one[:, width - 1 : 2 * width - 1]], axis=2)).reshape(len(one), 2 * width, 1)
        logs.reshape(len(one), 2 * width, 128 // width)[...] += now
    return Tree(step, logs, depth)


@dataclass(frozen=True)
class Model:
    depth: int
    gram_counts: DataFrame
    top: list[list[Nodes]]
    frequent_grams: np.ndarray
    frequent_logs: np.ndarray
    token_counts: DataFrame
    frequent: np.ndarray
    frequent_counts: np.ndarray
    tokens: int
    vocabulary: int
    chunk_rows: int


def fit(
    texts: DataFrame, text_col: str = "text", depth: int = DEPTH, token_share: float = TOKEN_SHARE, frequent_grams: int = FREQUENT_GRAMS, chunk_rows: int = CHUNK_ROWS
) -> Model:
    """Count all tokens and all byte contexts of the training texts; every context seen once has its node.

    Tasks count their own texts; the sums of all of them stay a table in the shared checkpoint folder. The
    tree's nodes are made where all counts of the same three nearest bytes are, and rolled up to the nodes of
    shorter contexts by a sum. The driver gets the nodes of contexts of at most two bytes, the
    ``frequent_grams`` most frequent bytes with their contexts, and the tokens that hold ``token_share`` of the
    tokens. What it gets only spares joins: no score depends on it.
    """
    sent = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(_counted(depth), "kind int, key long, n long")
    counts = checkpointed(sent.groupBy("kind", "key").agg(F.sum("n").alias("n")))
    tokens = counts.where(F.col("kind") == _TOKEN).select("key", "n")
    n, v = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count("*")).first()
    frequent = tokens.where(F.col("n") >= max(1.0, n * token_share)).orderBy("key").toArrow()

    grams = counts.where(F.col("kind") == _BYTES).select("key", "n")
    split = min(SPLIT, depth)
    rolled = _dealt(grams.withColumn("asked", F.lit(False)), depth).mapInArrow(_rolled_up(depth, chunk_rows), "j int, id long, zero double, one double, below double")
    upper = rolled.groupBy("j", "id").agg(*(F.sum(c).alias(c) for c in ("zero", "one", "below"))).orderBy("j", "id").toArrow()
    j, *state = (upper.column(c).to_numpy() for c in _UP.names)
    top = [_climbed(i, [x[j == i] for x in state], split - 1, 0)[0] for i in range(8)]

    # the least count from which at most frequent_grams keys are left, by bins of counts
    sizes = grams.groupBy(F.floor(F.log2("n") * 16).alias("bin")).agg(F.count("*").alias("keys"), F.min("n").alias("least"))
    least, taken = None, 0
    for row in sorted(sizes.collect(), reverse=True):
        taken += row.keys
        if taken > frequent_grams:
            break
        least = row.least
    asked = _dealt(grams.withColumn("asked", F.lit(False) if least is None else F.col("n") >= least), depth)
    logs = asked.mapInArrow(_asked(texts.sparkSession.sparkContext.broadcast(top), depth, chunk_rows), "key long, log double").orderBy("key").toArrow()
    return Model(
        depth, grams, top, logs.column("key").to_numpy(), logs.column("log").to_numpy(),
        tokens, frequent.column("key").to_numpy(), frequent.column("n").to_numpy(), n, v, chunk_rows,
    )


class Places:
    """Finds numbers in an array of distinct ones: by a table of twice to four times their places, free ones empty."""

    def __init__(self, keys: np.ndarray) -> None:
        self.keys = np.append(keys, 0)
        self.n, self.bits = len(keys), max(1, (2 * len(keys)).bit_length())
        self.slots = np.full(1 << self.bits, self.n, np.int32)
        left, at = np.arange(self.n, dtype=np.int32), self._first(keys)
        while len(left):
            free = self.slots[at] == self.n
            self.slots[at[free]] = left[free]  # of several for one slot, one stays
            moved = self.slots[at] != left
            left, at = left[moved], at[moved] + 1 & (1 << self.bits) - 1

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).view(np.int64)

    def find(self, wanted: np.ndarray) -> np.ndarray:
        """The place of each number, ``n`` if it has none."""
        at = self._first(wanted)
        found = self.slots[at]
        left = np.flatnonzero((self.keys[found] != wanted) & (found < self.n))
        while len(left):
            at[left] = at[left] + 1 & (1 << self.bits) - 1
            found[left] = now = self.slots[at[left]]
            left = left[(self.keys[now] != wanted[left]) & (now < self.n)]
        return found


_SCORED_DDL = "row long, doc_id long, n_tokens long, n_known long, base double, score double, n_bytes long, rare array<long>, grams array<long>"
_SCORED = pa.schema([(n, {"long": pa.int64(), "double": pa.float64()}.get(t, pa.list_(pa.int64()))) for n, t in (x.split() for x in _SCORED_DDL.split(", "))])


def score(df: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Scores of every whole text: ``doc_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte``.

    A-Z is lower-cased. Tokens are ``[^\\x20\\x09-\\x0D]+`` and one end. ``base_score`` sums log10 of the tokens'
    smoothed frequencies, ``n_known`` counts tokens that training texts have. ``score`` is log10 of the
    probability of the words, joined by single spaces, and the end, under the weighted context tree;
    ``bits_per_byte`` is its code length. One row for each row of ``df``.

    Frequent tokens and frequent bytes with their contexts come in a broadcast of bounded size; the other
    tokens are looked up in the table of counts by a join, and the other bytes, each distinct one once, in
    the nodes made again from the counts. A null or empty text is its end alone. Without training texts every bit has
    probability 1/2. An empty table gives no rows; other columns are not looked at.
    """
    shared = df.sparkSession.sparkContext.broadcast((model.frequent_grams, model.frequent_logs, model.frequent, np.log10(model.frequent_counts + 0.5)))
    depth = model.depth

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram_keys, gram_logs, keys, logs = shared.value
        grams, gram_logs = Places(gram_keys), np.append(gram_logs, 0.0)
        tokens, logs = Places(keys), np.append(logs, float("nan"))
        known: dict[bytes, float] = {}  # NaN: not in the broadcast
        row = task_id() << 40

        def look(words: set[bytes]) -> None:
            if len(known) + len(words) > 300_000:
                known.clear()
            new = list(words.difference(known))
            asked = np.fromiter(map(token_key, new), np.int64, len(new))
            known.update(zip(new, logs[tokens.find(asked)].tolist(), strict=True))

        def told(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            nonlocal row
            look(set().union(*texts))
            n_tokens = np.array([len(t) for t in texts])
            values = np.fromiter(map(known.__getitem__, chain.from_iterable(texts)), float, n_tokens.sum())
            starts = np.cumsum(n_tokens) - n_tokens
            rare = np.isnan(values)
            words = list(chain.from_iterable(texts))
            names = np.fromiter((token_key(words[i]) for i in np.flatnonzero(rare)), np.int64, np.count_nonzero(rare))
            n_rare = np.add.reduceat(rare, starts, dtype=np.int64)

            joined = [b" ".join(t[:-1]) + END for t in texts]
            sizes = np.array([len(t) for t in joined])
            firsts = np.cumsum(sizes) - sizes
            asked = _keys(joined, depth).astype(np.int64)
            at = grams.find(asked)
            missed = at == grams.n
            n_missed = np.add.reduceat(missed, firsts, dtype=np.int64)
            columns = [
                np.arange(row, row + len(ids)), ids, n_tokens, n_tokens - n_rare, np.add.reduceat(np.where(rare, 0.0, values), starts), np.add.reduceat(gram_logs[at], firsts), sizes,
                *(pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(n)], pa.int32()), pa.array(x)) for n, x in ((n_rare, names), (n_missed, asked[missed]))),
            ]
            row += len(ids)
            return pa.RecordBatch.from_arrays([c if isinstance(c, pa.Array) else pa.array(c, f.type) for c, f in zip(columns, _SCORED, strict=True)], schema=_SCORED)

        for batch in slices(batches):
            ids, texts, held = [], [], 0
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text")), strict=True):
                ids.append(doc_id)
                texts.append([*words_of(text), END_TOKEN])
                held += len(text)
                if held > 1 << 20:
                    yield told(ids, texts)
                    ids, texts, held = [], [], 0
            if ids:
                yield told(ids, texts)

    scored = checkpointed(id_and_text(df, id_col, text_col).mapInArrow(run, _SCORED_DDL))
    asked = scored.select("row", F.explode("rare").alias("key")).join(model.token_counts, "key", "left")
    rare = asked.groupBy("row").agg(F.sum(F.log10(F.coalesce("n", F.lit(0)) + 0.5)).alias("rare_base"), F.count("n").alias("rare_known"))
    missed = scored.select("row", F.explode("grams").alias("key"))
    once = missed.select("key", F.lit(0).cast("long").alias("n"), F.lit(True).alias("asked")).distinct()
    rows = _dealt(model.gram_counts.withColumn("asked", F.lit(False)).union(once), depth)
    top = df.sparkSession.sparkContext.broadcast(model.top)
    logs = rows.mapInArrow(_asked(top, depth, model.chunk_rows), "key long, log double")
    told = missed.join(logs, "key").groupBy("row").agg(F.sum("log").alias("rare_score"))
    whole = float(np.log10(model.tokens + 0.5 * (model.vocabulary + 1)))
    total = F.col("score") + F.coalesce("rare_score", F.lit(0.0))
    return scored.drop("rare", "grams").join(rare, "row", "left").join(told, "row", "left").select(
        "doc_id",
        "n_tokens",
        (F.col("n_known") + F.coalesce("rare_known", F.lit(0))).alias("n_known"),
        F.lit(model.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + F.coalesce("rare_base", F.lit(0.0)) - F.col("n_tokens") * whole).alias("base_score"),
        total.alias("score"),
        (-total * float(np.log2(10)) / F.col("n_bytes")).alias("bits_per_byte"),
    )
