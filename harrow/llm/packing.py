"""Best-fit packing by linear grouping, planned on the histogram of lengths.

Documents become token ids plus a closing 0; longer ones than ``capacity`` are cut into pieces. Then:

1. Count pieces by length: ``capacity`` rows at most, whatever the corpus. Only this goes to the driver.
2. Linear grouping: lengths over a bound are sorted, dealt into groups of equal cardinality and rounded up to the
   largest of their group. The few rounded sizes give a small linear program over bin configurations, solved by column
   generation (a knapsack table prices new configurations); configurations are used as often as the solution says,
   rounded down.
3. The actual lengths take the rounded slots, and the room that opens up, with all remaining large and the small
   pieces, is filled by best fit in descending length.

Everything is done on runs (length, first rank, count, first bin), so the plan is as small as the histogram; it is a
list of a few thousand runs. Each piece finds its run by its length and its rank among the pieces of that length. Ranks
come from counts by (length, hash bucket) and a row number inside each such cell. The number of buckets grows with the
pieces, so that a length that a third of all pieces have is split into cells of bounded size, and nothing is sorted as a
whole.

Defined cases: a null or empty text is one token (the closing 0); an empty table gives an empty result; repeated rows
are packed each for itself; other columns are left out of the work.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from harrow.llm.shared import arrow_rows, buckets_for, hash_bucket, kept_in_worker, read, staged
from harrow.llm.words import chunks

CAPACITY = 2048
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


#: Letters of Latin-1 with ASCII signs after them: such a word's ids are those of its lower-case letters, then of its signs.
SIMPLE = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!-&(-/:-@\[-`{-~]*)")


class _Codes(dict):
    """Words to numbers; unknown words get the next number and are noted in ``fresh``."""

    def __init__(self):
        self.fresh: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        n = self[word] = len(self)
        self.fresh.append(word)
        return n


class WordTokens:
    """Token ids of whole texts, by way of bounded stores of words and their parts: in this vocabulary no token crosses white space."""

    stores: dict[str, WordTokens] = {}  # one for a worker process: its tasks share what it has learnt

    def __init__(self, tokenizer_path: str, most_words: int = 600_000, most_parts: int = 900_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.most_words, self.most_parts = Tokenizer.from_file(tokenizer_path), most_words, most_parts
        self.parts: dict[str, tuple[int, ...]] = {"": ()}
        self.clear()

    @classmethod
    def of(cls, path: str) -> WordTokens:
        if path not in cls.stores:
            cls.stores[path] = cls(path)
        return cls.stores[path]

    def clear(self) -> None:
        self.code = _Codes()
        self.flat, self.starts = np.zeros(1 << 16, np.uint32), np.zeros(1, np.int64)

    def learn(self) -> None:
        """Ids of the words that ``code`` has noted."""
        cut = []
        for word in self.code.fresh:
            text = word.decode()
            m = SIMPLE.fullmatch(text)
            cut.append((m[1].lower(), m[2]) if m else (text, ""))
        if len(self.parts) > self.most_parts:
            self.parts = {"": ()}
        new = list({p for pair in cut for p in pair if p not in self.parts})
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            e = self.tokenizer.encode(some, is_pretokenized=True, add_special_tokens=False)
            ids: list[list[int]] = [[] for _ in some]
            for i, k in zip(e.ids, e.word_ids):
                ids[k].append(i)
            self.parts.update(zip(some, map(tuple, ids)))
        ids = [self.parts[a] + self.parts[b] for a, b in cut]
        size = np.fromiter(map(len, ids), np.int64, len(ids))
        more = np.fromiter((i for x in ids for i in x), np.uint32, int(size.sum()))
        used = int(self.starts[-1])
        if used + len(more) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(more)), np.uint32)])
        self.flat[used : used + len(more)] = more
        self.starts = np.concatenate([self.starts, used + np.cumsum(size)])
        self.code.fresh = []

    def ids(self, text: str | None) -> np.ndarray:
        return self.many([text])[0]

    def many(self, texts: list[str | None]) -> list[np.ndarray]:
        if len(self.code) > self.most_words:
            self.clear()
        words, count = [], []
        for t in texts:
            own = (t or "").encode("utf-8", "replace").split()  # splits at ASCII white space only
            words += own
            count.append(len(own))
        code = np.fromiter(map(self.code.__getitem__, words), np.int64, len(words))
        if self.code.fresh:
            self.learn()
        first, n = self.starts[code], self.starts[code + 1] - self.starts[code]
        ends = np.cumsum(n)
        flat = self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - n), n)]
        return np.split(flat, np.concatenate([[0], ends])[np.cumsum(count)[:-1]])


kept_in_worker.append(WordTokens.stores.clear)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]) of (doc_id, text). The path must hold on every executor; None: the installed package's file."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        tokens = WordTokens.of(tokenizer_path or default_tokenizer())
        for b in batches:
            rows, texts, docs_of = [], b["text"].tolist(), b["doc_id"].tolist()
            for lo, hi in chunks(texts):
                for doc, own in zip(docs_of[lo:hi], tokens.many(texts[lo:hi])):
                    ids = np.append(own, np.uint32(0)).astype("<u4")
                    for k, at in enumerate(range(0, len(ids), capacity)):
                        part = ids[at : at + capacity]
                        rows.append((doc, k, at, len(part), zlib.crc32(part.tobytes()), *([part.astype(np.int64)] if with_ids else [])))
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32", *["ids"] * with_ids])
            out["doc_id"] = out["doc_id"].astype("Int64")
            yield out

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInPandas(run, PIECES + ", ids array<long>" * with_ids)


def _configurations(sizes: np.ndarray, need: np.ndarray, capacity: int, rounds: int = 400) -> list[tuple[np.ndarray, int]]:
    """Configurations (copies of each size) and how often to use each: the linear program by column generation, rounded down."""
    k = len(sizes)
    basis = np.diag(capacity // sizes).astype(float)
    for _ in range(rounds):
        inverse = np.linalg.inv(basis)
        x, price = inverse @ need, inverse.sum(0)
        best, pick = np.zeros(capacity + 1), np.full(capacity + 1, -1)
        for c in range(int(sizes.min()), capacity + 1):
            ok = sizes <= c
            value = np.where(ok, best[np.where(ok, c - sizes, 0)] + price, -1.0)
            g = int(value.argmax())
            if value[g] > best[c - 1] + 1e-12:
                best[c], pick[c] = value[g], g
            else:
                best[c] = best[c - 1]
        if best[capacity] <= 1 + 1e-7:
            break
        column, c = np.zeros(k), capacity
        while c > 0:
            if pick[c] < 0:
                c -= 1
            else:
                column[pick[c]] += 1
                c -= int(sizes[pick[c]])
        step = inverse @ column
        ratio = np.where(step > 1e-9, x / np.where(step > 1e-9, step, 1), np.inf)
        basis[:, int(ratio.argmin())] = column
    x = np.linalg.inv(basis) @ need
    return [(basis[:, j].astype(int), int(np.floor(x[j] + 1e-9))) for j in range(k) if x[j] >= 1]


class _Room:
    """Open bins by room left, as runs (first bin, count)."""

    def __init__(self, capacity: int):
        self.runs: list[list[tuple[int, int]]] = [[] for _ in range(capacity + 1)]
        self.capacity, self.bins = capacity, 0

    def add(self, room: int, first: int, n: int) -> None:
        if n > 0 and room > 0:
            self.runs[room].append((first, n))

    def best_fit(self, length: int, rank: int, n: int, out: list) -> None:
        """Puts ``n`` pieces, ranks from ``rank``, where single best fit would."""
        room = length
        while n > 0:
            while room <= self.capacity and not self.runs[room]:
                room += 1
            if room > self.capacity:
                first, q, at = self.bins, -(-n // (self.capacity // length)), self.capacity
                self.bins, room = self.bins + q, self.capacity
            else:
                (first, q), at = self.runs[room].pop(), room
            each = at // length
            full = min(q, n // each)
            if full:
                out.append((length, rank, full * each, each, first, self.capacity - at))
                self.add(at - each * length, first, full)
                rank, n = rank + full * each, n - full * each
            elif n:
                out.append((length, rank, n, n, first, self.capacity - at))
                self.add(at - n * length, first, 1)
                full, n = 1, 0
            self.add(at, first + full, q - full)


def _plan(counts: dict[int, int], capacity: int, groups: int, large: int) -> tuple[int, list[tuple]]:
    out: list[tuple] = []
    room = _Room(capacity)
    big = [(length, counts[length]) for length in sorted(counts, reverse=True) if length > large]
    total = sum(n for _, n in big)
    left: dict[int, list[tuple[int, int]]] = {length: [(0, n)] for length, n in counts.items()}
    if total:
        per = -(-total // groups)
        queues: dict[int, list[list[int]]] = {}  # rounded size -> runs [length, rank, n], longest first
        filled, size = per, 0
        for length, n in big:
            rank = 0
            while n:
                if filled == per:
                    filled, size = 0, length
                take = min(n, per - filled)
                queues.setdefault(size, []).append([length, rank, take])
                filled, rank, n = filled + take, rank + take, n - take
        sizes = np.array(sorted(queues, reverse=True))
        need = np.array([sum(r[2] for r in queues[s]) for s in sizes], float)
        left = {length: runs for length, runs in left.items() if length <= large}
        for config, times in _configurations(sizes, need, capacity):
            slots = []
            for s, copies in zip(sizes, config):
                for _ in range(copies):
                    want, runs = times, []
                    queue = queues[int(s)]
                    while want and queue:
                        take = min(want, queue[0][2])
                        runs.append([queue[0][0], queue[0][1], take])
                        queue[0][1] += take
                        queue[0][2] -= take
                        want -= take
                        if not queue[0][2]:
                            queue.pop(0)
                    slots.append(runs)
            first, bins_left = room.bins, times
            room.bins += times
            while bins_left:
                q = min([bins_left, *(runs[0][2] for runs in slots if runs)])
                at = 0
                for runs in slots:
                    if runs:
                        length, rank, n = runs[0]
                        out.append((length, rank, q, 1, first, at))
                        at += length
                        runs[0] = [length, rank + q, n - q]
                        if n == q:
                            runs.pop(0)
                if not at:  # no pieces left for these bins
                    room.bins -= bins_left
                    break
                room.add(capacity - at, first, q)
                first, bins_left = first + q, bins_left - q
        for queue in queues.values():
            for length, rank, n in queue:
                left.setdefault(length, []).append((rank, n))
    for length in sorted(left, reverse=True):
        for rank, n in left[length]:
            room.best_fit(length, rank, n, out)
    return room.bins, out


def plan(counts: dict[int, int], capacity: int = CAPACITY, tries: tuple[tuple[int, int], ...] = ((24, 2), (40, 3), (40, 4))) -> tuple[int, list[tuple]]:
    """(sequences, runs (length, rank, n, each, first bin, offset)) of the best of a few (groups, capacity / large bound)."""
    if not counts:
        return 0, []
    return min((_plan(dict(counts), capacity, g, capacity // part) for g, part in tries), key=lambda p: p[0])


def pack(cut: DataFrame, capacity: int = CAPACITY, buckets: int | None = None) -> DataFrame:
    """``cut`` (with doc_id, piece, length; a written table, as it is counted first) plus sequence_id and offset."""
    spark, buckets = cut.sparkSession, buckets or buckets_for(cut.count())
    keyed = cut.withColumn("bucket", hash_bucket(buckets, F.col("doc_id"), F.col("piece")))
    cells = staged(keyed.groupBy("length", "bucket").agg(F.count(F.lit(1)).alias("n")), "pack-cells")
    counts = {int(r[0]): int(r[1]) for r in cells.groupBy("length").agg(F.sum("n")).collect()}  # capacity rows at most
    _, runs = plan(counts, capacity)
    schema = "length long, rank long, n long, each long, first long, offset long"
    table = spark.createDataFrame(runs, schema).groupBy("length").agg(F.sort_array(F.collect_list(F.struct("rank", "each", "first", "offset"))).alias("runs"))
    earlier = Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = cells.withColumn("base", F.coalesce(F.sum("n").over(earlier), F.lit(0))).drop("n")
    look = base.join(F.broadcast(table), "length")  # the plan: bounded by the capacity, not by the corpus
    inside = Window.partitionBy("length", "bucket").orderBy("doc_id", "piece")
    ranked = keyed.withColumn("rn", F.row_number().over(inside) - 1).join(look, ["length", "bucket"])
    ranked = ranked.withColumn("rank", F.col("base") + F.col("rn"))
    run = F.element_at(F.filter("runs", lambda r: r["rank"] <= F.col("rank")), -1)
    placed = ranked.withColumn("run", run).withColumn("nth", F.col("rank") - F.col("run.rank"))
    return placed.withColumns({
        "sequence_id": F.col("run.first") + F.floor(F.col("nth") / F.col("run.each")),
        "offset": F.col("run.offset") + (F.col("nth") % F.col("run.each")) * F.col("length"),
    }).drop("bucket", "rn", "base", "runs", "rank", "run", "nth")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) of pieces that carry ``ids``; a sequence holds ``capacity`` tokens at most."""
    return packed.groupBy("sequence_id").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("offset", "ids"))), lambda x: x["ids"])).alias("ids"))


def pack_documents(docs: DataFrame, tokenizer_path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    with arrow_rows(docs.sparkSession, 500):
        cut = staged(pieces(docs, tokenizer_path, capacity), "pack-pieces")
    return pack(cut, capacity)


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(read(spark, sf_dir, "documents").select("doc_id", "text")).select(
        "doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
