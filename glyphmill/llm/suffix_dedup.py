"""Repeated passages by a distributed, prefix-aware merge sort of suffixes.

Every window of ``min_words`` words belongs to one anchor, the position of the
least of its 10-word blocks by hash. The anchor depends on the window's words
alone, so equal windows have equal anchors at equal distances, and only windows
whose anchor's block stands in two texts can be repeated. A count of the blocks at
anchors, one in about twenty words, finds those; the rest of the text takes no
further part, and equal texts are one text from the start.

A suffix begins at each window that is left. Tasks sort their suffixes, as
sequences of block symbols up to the prefix that tells repeated from unrepeated
ones, into runs. A run keeps the places of equal suffixes to itself and sends each
distinct one once, so a passage that a third of all texts share is one suffix a
run. Runs are cut at fixed key ranges, as many as the number of suffixes asks for,
and sent front-coded: of each suffix the length of the prefix shared with the
suffix before it and only the symbols after that. A bucket merges its runs with a
loser tree that carries those lengths along, so a comparison starts where the
known common prefix ends. Neighbours in merged order whose common prefix is
``min_words`` words are a repeated passage; the runs get that answer back.

Whatever is sent goes in rows of at most some 64 KB: an executor's buffers for
Arrow and for the pages of files grow to the largest that they met and stay so.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glyphmill.llm import _text
from glyphmill.llm._shared import bound_batches, col, cut, digest, marked
from glyphmill.ship import ship

BLOCK = 10
PIECE = 1 << 16
_FULL = 1 << 64
_SALT = 0x5851F42D4C957F2D


def _slide_argmin(v: np.ndarray, w: int) -> np.ndarray:
    """Index of the least value (the leftmost, in ties) of each w consecutive values."""
    n = len(v) - w + 1
    least = np.arange(len(v))
    value, span = v, 1
    while span < w:
        step = min(span, w - span)
        left, right = value[: len(value) - step], value[step:]
        take = right < left
        least = np.where(take, least[step:], least[: len(least) - step])
        value = np.where(take, right, left)
        span += step
    return least[:n]


class _Windows:
    """The windows of ``n`` words of some texts: ``at`` where each begins among all
    words, ``anchor`` of each, ``text`` that it is in; ``of`` where texts begin,
    ``blocks`` the hash of the block at each word."""

    def __init__(self, texts: list[str], n: int):
        h, _, _, self.of = _text.words(texts)
        size = min(BLOCK, n)
        self.blocks = _text.shingles(h, size)
        self.at = np.flatnonzero(_text.inside(self.of, n))
        # least by another hash than the symbol's own, else keys would crowd near 0
        self.anchor = _slide_argmin(_text.mix(self.blocks ^ np.uint64(_SALT)), n - size + 1)[self.at] if len(self.at) else self.at
        self.text = np.searchsorted(self.of, self.at, side="right") - 1
        last = n - size
        self.offsets = [*range(0, last, size), last]

    def symbols(self, starts: np.ndarray) -> list[np.ndarray]:
        """Blocks that together cover the window from each start: all first ones, all second ones and so on."""
        return [self.blocks[starts + o] for o in self.offsets]


def encode_run(keys: np.ndarray, base: int, least: np.ndarray, several: np.ndarray, before: np.ndarray | None = None) -> bytes:
    """Distinct suffixes sorted by key, the first being number ``base`` of its run and
    the one ``before`` it in the piece before, front-coded; of each the least text that
    has it and whether several documents do."""
    n, depth = keys.shape
    lcp = np.zeros(n, np.uint8)
    if n > 1:
        lcp[1:] = np.cumprod(keys[1:] == keys[:-1], axis=1).sum(axis=1)
    if n and before is not None:
        lcp[0] = np.cumprod(keys[0] == before).sum()
    rest = keys[np.arange(depth)[None, :] >= lcp[:, None]]
    head = np.array([n, depth, len(rest), base], np.int64)
    return b"".join(x.tobytes() for x in (head, rest, least.astype(np.int64), lcp, several.astype(np.uint8)))


class Run:
    """A front-coded run, read back from its pieces in their order."""

    def __init__(self, *pieces):
        self.n = 0
        self.coded: list[tuple[np.ndarray, np.ndarray]] = []
        least, several = [], []
        for piece in pieces:
            n, self.depth, n_rest, base = np.frombuffer(piece, np.int64, 4).tolist()
            if not self.n:
                self.base = base
            self.n += n
            at, parts = 32, []
            for kind, count in ((np.uint64, n_rest), (np.int64, n), (np.uint8, n), (np.uint8, n)):
                parts.append(np.frombuffer(piece, kind, count, at))
                at += parts[-1].nbytes
            self.coded.append((parts[2], parts[0]))
            least.append(parts[1])
            several.append(parts[3].astype(bool))
        self.least, self.several = np.concatenate(least), np.concatenate(several)

    def heads(self, step: int = 4096) -> Iterator[tuple[int, list[int]]]:
        """(prefix shared with the suffix before, symbols) of each suffix in turn."""
        key: list[int] = []
        depth = self.depth
        for lcps, symbols in self.coded:
            at = 0
            for begin in range(0, len(lcps), step):
                lcp = lcps[begin : begin + step]
                size = int((depth - lcp.astype(np.int64)).sum())
                rest, lcp = symbols[at : at + size].tolist(), lcp.tolist()
                at, i = at + size, 0
                for shared in lcp:
                    if shared < depth:
                        key = key[:shared] + rest[i : i + depth - shared]
                        i += depth - shared
                    yield shared, key


def merge(runs: list) -> Iterator[tuple[int, int]]:
    """Merges sorted runs with a loser tree: (run, prefix shared with the suffix
    put out before). A node keeps the loser of its match; ``lcp`` has, for each
    run's head, the known prefix in common with the suffix last put out. The head
    with the longer known prefix is the smaller; only heads of equal known
    prefixes are compared, from that prefix on. Ties go to the lower run."""
    k = 1
    while k < len(runs):
        k *= 2
    heads = [r.heads() for r in runs]
    lcp, key = [-1] * k, [None] * k
    for i, it in enumerate(heads):
        for _, key[i] in [next(it, (0, None))]:
            lcp[i] = 0 if key[i] is not None else -1
    tree = [0] * k

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser)"""
        la, lb = lcp[a], lcp[b]
        if la != lb:
            return (a, b) if la > lb else (b, a)
        if la < 0:
            return a, b
        ka, kb, j = key[a], key[b], la
        depth = len(ka)
        while j < depth and ka[j] == kb[j]:
            j += 1
        if (a < b) if j == depth else (ka[j] < kb[j]):
            lcp[b] = j
            return a, b
        lcp[a] = j
        return b, a

    level = list(range(k))
    while len(level) > 1:
        half = len(level) // 2
        up = []
        for i in range(half):
            winner, tree[half + i] = play(level[2 * i], level[2 * i + 1])
            up.append(winner)
        level = up
    winner = level[0]
    while lcp[winner] >= 0:
        yield winner, lcp[winner]
        head = next(heads[winner], None)
        if head is None:
            lcp[winner] = -1
        else:
            lcp[winner], key[winner] = head
        node = (k + winner) >> 1
        while node:
            other = tree[node]
            lo, lw = lcp[other], lcp[winner]
            if lo > lw:
                tree[node], winner = winner, other
            elif lo == lw and lw >= 0:
                best, worse = play(winner, other)
                tree[node], winner = worse, best
            node >>= 1


def _repeated(runs: list[Run], names: list[int]) -> Iterator[pa.RecordBatch]:
    """Of the runs' distinct suffixes that several documents have: by run, their
    numbers and the least text of all that have them. The runs are spent by it."""
    order = np.fromiter(merge(runs), [("run", np.int32), ("lcp", np.int32)], sum(r.n for r in runs))
    for r in runs:
        r.coded.clear()
    if not len(order):
        return
    run, lcp = order["run"], order["lcp"]
    place = np.argsort(run, kind="stable")  # each run's suffixes come in its own order
    least, several = np.empty(len(run), np.int64), np.empty(len(run), bool)
    least[place] = np.concatenate([r.least for r in runs])
    several[place] = np.concatenate([r.several for r in runs])
    first = np.flatnonzero(lcp < runs[0].depth)  # less than the whole window in common with the one before
    low, high = np.minimum.reduceat(least, first), np.maximum.reduceat(least, first)
    yes = (low < high) | np.logical_or.reduceat(several, first)
    size = np.diff(np.append(first, len(run)))
    least, several = np.repeat(low, size), np.repeat(yes, size)
    del order, run, lcp, first, low, high, yes, size
    at, step = 0, PIECE // 8
    for name, one in zip(names, runs, strict=True):
        mine = place[at : at + one.n]
        at += one.n
        nth = np.flatnonzero(several[mine])
        for i in range(0, len(nth), step):
            some = nth[i : i + step]
            numbers, sources = (one.base + some).astype(np.int32).tobytes(), least[mine[some]].tobytes()
            yield pa.RecordBatch.from_arrays([pa.array([name], pa.int64()), pa.array([numbers], pa.binary()), pa.array([sources], pa.binary())], ["run", "numbers", "sources"])


def _stretches(tid, start, source, n: int):
    """Ranges that windows (sorted by text and start) cover: text, begin, end, least source."""
    if not len(tid):
        return (np.empty(0, np.int64),) * 4
    new = np.ones(len(tid), bool)
    new[1:] = (tid[1:] != tid[:-1]) | (start[1:] > start[:-1] + n)
    a = np.flatnonzero(new)
    b = np.append(a[1:], len(tid)) - 1
    return tid[a], start[a], start[b] + n, np.minimum.reduceat(source, a)


def _answered(members: bytes, numbers: list, sources: list, n: int) -> list[tuple]:
    """Of a run's places, after its suffixes' answers: (copy, is_first, stretches)."""
    size = np.frombuffer(members, np.int64, 3)
    at = 24
    parts = []
    for kind, count in ((np.int64, size[0]), (np.int32, size[0]), (np.int32, size[1]), (np.int64, size[2]), (np.int32, size[2]), (np.uint8, size[0])):
        parts.append(np.frombuffer(members, kind, count, at))
        at += parts[-1].nbytes
    tid, start, sizes, own, own_start, copied = parts
    source = np.full(len(sizes), -1, np.int64)
    for a, b in zip(numbers, sources, strict=True):
        source[np.frombuffer(a, np.int32)] = np.frombuffer(b, np.int64)
    source = np.repeat(source, sizes)
    first = np.zeros(len(tid), bool)
    first[np.cumsum(sizes) - sizes] = True
    first &= source == tid
    yes = source >= 0
    tid, start, source, first, copied = (np.concatenate(x) for x in ((tid[yes], own), (start[yes].astype(np.int64), own_start.astype(np.int64)), (source[yes], own), (first[yes], np.ones(len(own), bool)), (copied[yes] > 0, np.ones(len(own), bool))))
    order = np.lexsort((start, tid))
    tid, start, source, first, copied = tid[order], start[order], source[order], first[order], copied[order]
    return [(copy, is_first, _stretches(tid[m], start[m], source[m], n)) for copy, is_first, m in ((False, True, first), (False, False, ~first), (True, False, copied))]


def suffix_dedup(docs: DataFrame, min_words: int = 50, id_col: str = "doc_id", text_col: str = "text", run_suffixes: int = 1_000_000, bucket_suffixes: int = 1_000_000) -> DataFrame:
    """Passages of ``min_words`` words or more that occur in two or more documents.

    One row for each maximal stretch of a document covered by repeated windows:
    ``doc_id, start_word, end_word, n_words, source_doc_id, is_first``; words
    count from 0, the end is past the last. ``is_first`` rows hold the first
    occurrences (the least doc_id, then the least position), the others may be
    cut out; ``source_doc_id`` is the least doc_id that shares a window of the
    stretch. Words are compared in lower case without punctuation.

    Every row is a document, so what rows of one id or repeated rows share is
    repeated; ids may be of any type, null ids come last and have rows as others.
    Null text and text of fewer words has no passage. Other columns are ignored.
    An empty table gives an empty result. ``run_suffixes`` and ``bucket_suffixes``
    bound what a task holds, never the result.
    """
    ship(docs.sparkSession)
    bound_batches(docs.sparkSession)
    rows = docs.select(col(id_col).alias("id"), digest(col(text_col)).alias("dg"), col(text_col).alias("t")).where("t is not null")
    size = min(BLOCK, min_words)

    def anchors(batches):
        for batch in batches:
            for first, group in _text.pieces(batch.column(1)):
                w = _Windows(group, min_words)
                one = np.flatnonzero(np.concatenate(([True], w.anchor[1:] != w.anchor[:-1]))) if len(w.at) else w.at
                p, text = w.anchor[one], w.text[one]
                digests = batch.column(0).take(pa.array(first + text))
                yield pa.RecordBatch.from_arrays([digests, pa.array((p - w.of[text]).astype(np.int32)), pa.array(w.blocks[p].view(np.int64))], ["dg", "pos", "h"])

    named = cut(rows.select("id", "dg").withColumn("rid", F.monotonically_increasing_id()))
    texts = named.groupBy("dg").agg(F.min(F.struct(F.col("id").isNull().alias("z"), "id", "rid")).alias("head"), (F.count("*") > 1).alias("copied"))
    found = cut(rows.select("dg", "t").mapInArrow(anchors, "dg binary, pos int, h long"))
    shared = found.groupBy("h").agg(F.min("dg").alias("a"), F.max("dg").alias("b")).where("a <> b").select("h")
    places = found.join(shared, "h", "left_semi").groupBy("dg").agg(F.collect_set("pos").alias("at"))
    chosen = texts.join(places, "dg", "left").where("copied or at is not null")
    # numbers in the order of the documents, so that the least number is the first
    chosen = cut(chosen.orderBy("head").withColumn("tid", F.monotonically_increasing_id()).select("tid", "dg", "head", "copied", F.coalesce("at", F.array().cast("array<int>")).alias("at")))
    n_anchors = chosen.agg(F.sum(F.size("at"))).first()[0] or 0
    buckets = max(1, -(-n_anchors * (min_words - size + 2) // (2 * bucket_suffixes)))
    edges = np.array([_FULL * b // buckets for b in range(1, buckets)], np.uint64)

    def runs(batches):
        held: list = []
        count, depth = 0, len(range(0, min_words - size, size)) + 1

        def sent(rows):
            """Of (bucket, data) in turn, batches of about 1 MB."""
            at, data, size = [], [], 0
            for b, x in rows:
                at.append(b)
                data.append(x)
                size += len(x)
                if size >= 16 * PIECE:
                    yield at, data
                    at, data, size = [], [], 0
            if at:
                yield at, data

        def rows_of_run():
            tid, start, copied, own, own_start = (np.concatenate([x[i] for x in held]) for i in (0, 1, 3, 4, 5))
            keys = []
            for j in range(depth):
                keys.append(np.concatenate([x[2][j] for x in held]))
                for x in held:
                    x[2][j] = None
            held.clear()
            order = np.lexsort((start, tid, *keys[::-1]))
            tid, start, copied = tid[order], start[order], copied[order]
            new = np.zeros(len(tid), bool)
            new[:1] = True
            for j in range(depth):
                keys[j] = keys[j][order]
                new[1:] |= keys[j][1:] != keys[j][:-1]
            del order
            first = np.flatnonzero(new)
            sizes = np.diff(np.append(first, len(tid)))
            several = tid[first] != tid[first + sizes - 1]
            if len(first):
                several |= np.logical_or.reduceat(copied, first)
            head = np.array([len(tid), len(first), len(own)], np.int64)
            members = b"".join(x.tobytes() for x in (head, tid, start.astype(np.int32), sizes.astype(np.int32), own, own_start.astype(np.int32), copied.astype(np.uint8)))
            least = tid[first]
            del tid, start, own, own_start, copied, new, sizes
            for i in range(0, len(members), PIECE):
                yield -1 - i // PIECE, members[i : i + PIECE]
            del members
            cuts = np.concatenate(([0], np.searchsorted(keys[0][first], edges), [len(first)])).tolist()
            step = max(1, PIECE // (8 * depth + 10))
            for b, (low, high) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
                before = None
                for i in range(low, high, step):
                    here = slice(i, min(i + step, high))
                    distinct = np.stack([k[first[here]] for k in keys], axis=1)
                    yield b, encode_run(distinct, i, least[here], several[here], before)
                    before = distinct[-1]

        def flush():
            name = uuid.uuid4().int >> 65
            for at, data in sent(rows_of_run()):
                yield pa.RecordBatch.from_arrays([pa.array([name] * len(at), pa.int64()), pa.array(at, pa.int32()), pa.array(data, pa.binary())], ["run", "bucket", "data"])

        for batch in batches:
            tids, copies = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 1))
            for first, group in _text.pieces(batch.column(3)):
                w = _Windows(group, min_words)
                here = np.zeros(int(w.of[-1]) + 1, bool)
                at = batch.column(2).slice(first, len(group))
                here[np.repeat(w.of[:-1], at.value_lengths().to_numpy(zero_copy_only=False)) + at.flatten().to_numpy(zero_copy_only=False)] = True
                sorted_ = here[w.anchor]
                of, s = first + w.text, w.at - w.of[w.text]
                alone = ~sorted_ & copies[of]  # of texts with copies: no other text has them
                held.append((tids[of[sorted_]], s[sorted_], w.symbols(w.at[sorted_]), copies[of[sorted_]], tids[of[alone]], s[alone]))
                count += len(sorted_) and int(sorted_.sum() + alone.sum())
                if count >= run_suffixes:
                    yield from flush()
                    count = 0
        if count:
            yield from flush()

    def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coded: dict[int, list] = {}
        for batch in batches:
            for name, data in zip(batch.column("run").to_pylist(), batch.column("data"), strict=True):
                coded.setdefault(name, []).append(data.as_buffer())
        for x in coded.values():  # pieces may come in any order
            x.sort(key=lambda piece: np.frombuffer(piece, np.int64, 4)[3])
        names = list(coded)
        yield from _repeated([Run(*coded.pop(name)) for name in names], names)

    def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        members, numbers, sources = {}, [], []
        for batch in batches:
            for b, data, number, source in zip(batch.column("bucket").to_pylist(), *(batch.column(x) for x in ("data", "numbers", "sources")), strict=True):
                if data.is_valid:
                    members[-b] = data.as_buffer()
                else:
                    numbers.append(number.as_buffer())
                    sources.append(source.as_buffer())
        # a run holds each text of a row once; the same row's text may be in two runs
        got = _answered(b"".join(members[i] for i in sorted(members)), numbers, sources, min_words)
        cols = [np.concatenate([g[2][i] for g in got]) for i in range(4)]
        flags = [np.concatenate([np.full(len(g[2][0]), g[i]) for g in got]) for i in (0, 1)]
        yield pa.RecordBatch.from_arrays([*(pa.array(c.astype(np.int64)) for c in cols), *(pa.array(f.astype(bool)) for f in flags)], ["tid", "s", "e", "source", "copy", "is_first"])

    wanted = chosen.select("tid", "copied", "at", F.col("dg").alias("y"), F.col("head.id").alias("x"))
    asked = marked(rows, "asked", [F.col("dg"), F.col("id")], chosen, [F.col("dg"), F.col("head.id")]).where("asked").drop("asked")
    sent = asked.join(wanted, (F.col("y") == F.col("dg")) & F.col("x").eqNullSafe(F.col("id"))).select("tid", "copied", "at", "t")
    pieces = cut(sent.mapInArrow(runs, "run long, bucket int, data binary"))
    answers = pieces.where("bucket >= 0").groupBy("bucket").applyInArrow(merged, "run long, numbers binary, sources binary")
    members = pieces.where("bucket < 0").select("run", "bucket", "data", F.lit(None).cast("binary").alias("numbers"), F.lit(None).cast("binary").alias("sources"))
    both = members.union(answers.select("run", F.lit(0).alias("bucket"), F.lit(None).cast("binary").alias("data"), "numbers", "sources"))
    ranges = both.groupBy("run").applyInArrow(answered, "tid long, s long, e long, source long, copy boolean, is_first boolean").distinct()
    origin = chosen.select(F.col("tid").alias("source"), F.col("head.id").alias("source_doc_id"))
    placed = ranges.join(origin, "source").join(chosen.select("tid", "dg", "head"), "tid").join(named, "dg").where(F.col("copy") == (F.col("rid") != F.col("head.rid")))
    return placed.select(F.col("id").alias("doc_id"), F.col("s").alias("start_word"), F.col("e").alias("end_word"), (F.col("e") - F.col("s")).alias("n_words"), "source_doc_id", "is_first")
