"""Fuzzy line deduplication: SimHash and MinHash blocks of normalised lines, edit similarity, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.llm import edits, linking
from larkspur.llm.base import arrow_rows, join_side, materialize, normalized
from larkspur.llm.textvec import mix, row_chunks, shingle_hashes, utf8, word_hashes

THRESHOLD = 0.8
#: For each byte value, its eight bits spread over the eight bytes of a word: sums of up to 255 stay apart.
_SPREAD = np.array([sum(((b >> j) & 1) << (8 * j) for j in range(8)) for b in range(256)], np.uint64)
_RUN = 255
#: Blocks of three MinHash registers: of five-byte grams in lines of at most CHAR_LINE characters, of word pairs in lines of
#: at least 0.8 of that, so that a pair on both sides of the limit has one kind in common.
CHAR_LINE, CHAR_BLOCKS, PAIR_BLOCKS, REGISTERS, GRAM = 96, 16, 12, 3, 5
#: Lines of at most so many characters may differ in two at the threshold: they are found by what is left without two.
SHORT = 14
#: Nodes of a block of a key, of which each pair is compared in one place; pairs that are compared at once there.
NODES, PAIRS = 500, 1 << 20
#: Pairs of which keys or texts are looked up at once.
TOGETHER = 1 << 14
#: Lines of at least so many words whose SimHashes differ in more than so many of the 192 bits are not compared further.
SCREENED_WORDS, FAR_BITS = 8, 76
#: Lines that a task remembers to have signed, about.
SEEN = 1 << 19
#: Lines of more characters are compared pair by pair, in long integers; shorter ones many pairs at once.
LONG_LINE = 4096


def simhash(words: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """192-bit SimHash of each row's words (rows x 3, int64); every row needs a word.

    The second, third ... occurrence of a word are features of their own, so that a word that fills a line
    does not make it like every other line with that word.
    """
    n, counts = len(rows) - 1, np.diff(rows)
    row = np.repeat(np.arange(n, dtype=np.uint64), counts)
    keys = np.sort((row << np.uint64(44)) | (words >> np.uint64(20)))
    new = np.append(True, keys[1:] != keys[:-1])
    begin = np.flatnonzero(new)
    occurrence = np.arange(len(keys)) - begin[np.cumsum(new) - 1]
    words = mix((keys & np.uint64((1 << 44) - 1)) + (occurrence.astype(np.uint64) << np.uint64(44)))
    out = np.zeros((n, 3), np.int64)
    # runs of at most 255 words, so that the bit counts of a run fit a byte each
    runs_of = (counts + _RUN - 1) // _RUN
    first_run = np.concatenate(([0], np.cumsum(runs_of)))
    run_row = np.repeat(np.arange(n), runs_of)
    run_start = rows[:-1][run_row] + _RUN * (np.arange(first_run[-1]) - first_run[:-1][run_row])
    for k in range(3):
        code = mix(words, k + 1).view(np.uint8).reshape(-1, 8)
        ones = np.empty((n, 64), np.int64)
        for byte in range(8):
            sums = np.add.reduceat(_SPREAD[code[:, byte]], run_start)
            each = np.ascontiguousarray(sums).view(np.uint8).reshape(-1, 8).astype(np.int64)
            ones[:, 8 * byte : 8 * byte + 8] = np.add.reduceat(each, first_run[:-1], axis=0) if len(each) > n else each
        # in a tie, frequent in short lines, the bit of the line's first word by hash decides
        first = code[rows[:-1]]
        # of two words every bit that differs is a tie: there both decide, or all lines with one word would be alike
        two = np.flatnonzero(counts == 2)
        with np.errstate(over="ignore"):
            first[two] = mix(words[rows[two]] + words[rows[two] + 1], k + 1).view(np.uint8).reshape(-1, 8)
        lead = np.unpackbits(first, axis=1, bitorder="little") > 0
        set_bits = (2 * ones > counts[:, None]) | ((2 * ones == counts[:, None]) & lead)
        out[:, k] = np.packbits(set_bits, axis=1, bitorder="little").view(np.int64)[:, 0]
    return out


def char_grams(data: np.ndarray, offsets: np.ndarray, n: int = GRAM) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-byte grams of all rows and each row's first; a shorter row is one gram."""
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    at, end = np.arange(len(data)), offsets[1:][row]
    padded = np.concatenate((data.astype(np.uint64) + np.uint64(1), np.zeros(n, np.uint64)))
    out = np.zeros(len(data), np.uint64)
    with np.errstate(over="ignore"):
        for j in range(n):
            out = out * np.uint64(1099511628211) + np.where(at + j < end, padded[j : j + len(data)], np.uint64(0))
    keep = (at + n <= end) | (at == offsets[:-1][row])
    return mix(out[keep]), np.append(0, np.cumsum(keep))[offsets]


def minhash_blocks(hashes: np.ndarray, firsts: np.ndarray, blocks: int) -> np.ndarray:
    """32-bit hashes (rows x blocks) of REGISTERS MinHash registers each; every row needs a feature.

    A register is the least of the features' mixed hashes times an odd number of its own.
    """
    out = np.zeros((len(firsts) - 1, blocks), np.uint64)
    if len(out):
        odd = mix(np.arange(blocks * REGISTERS, dtype=np.uint64), 7) | np.uint64(1)
        times = np.empty_like(hashes)
        with np.errstate(over="ignore"):
            for b in range(blocks):
                for r in range(REGISTERS):
                    np.multiply(hashes, odd[b * REGISTERS + r], out=times)
                    out[:, b] = mix(out[:, b] * np.uint64(31) + np.minimum.reduceat(times, firsts[:-1]))
    return out >> np.uint64(32)


def rows_of(features: np.ndarray, firsts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The features of some rows, in order, and where each row's begin."""
    counts = np.diff(firsts)
    wanted = np.zeros(len(counts), bool)
    wanted[rows] = True
    return features[np.repeat(wanted, counts)], np.append(0, np.cumsum(counts[rows]))


def deletions(line: str) -> set[str]:
    """The line without up to as many characters as it may differ in from a line of its length, or one more."""
    most = 2 if len(line) >= 8 else int(len(line) >= 4)
    return {"".join(line[i] for i in range(len(line)) if i not in out) for n in range(most + 1) for out in combinations(range(len(line)), n)}


def block_keys(norm: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Keys of each line (int64, a hash of 32 bits below the kind of block) and the index of each line's first."""
    data, offsets = utf8(norm)
    n, size = len(norm), pc.utf8_length(norm).to_numpy(zero_copy_only=False)
    words = word_hashes(data, offsets)
    parts = [(np.repeat(np.arange(n), 6), simhash(*words).view(np.uint32).reshape(-1).astype(np.uint64), np.tile(np.arange(6), n))]
    brief = np.flatnonzero(size <= CHAR_LINE)
    for rows, features, blocks, kind in (
        (brief, lambda rows: char_grams(*utf8(norm.take(pa.array(rows)))), CHAR_BLOCKS, 6),
        (np.flatnonzero(size >= 0.8 * CHAR_LINE), lambda rows: rows_of(*shingle_hashes(*words, 2), rows), PAIR_BLOCKS, 6 + CHAR_BLOCKS),
    ):
        values = minhash_blocks(*features(rows), blocks)
        parts.append((np.repeat(rows, blocks), values.reshape(-1), np.tile(np.arange(kind, kind + blocks), len(rows))))
    left = [(i, d) for i, line in zip(brief.tolist(), norm.take(pa.array(brief)).to_pylist()) if len(line) <= SHORT for d in deletions(line)]
    if left:
        # the hash of a whole text, as of one long word
        texts = pa.array([d.replace(" ", "_") or "_" for _, d in left])
        parts.append((np.array([i for i, _ in left]), word_hashes(*utf8(texts))[0] >> np.uint64(32), np.full(len(left), 6 + CHAR_BLOCKS + PAIR_BLOCKS)))
    row, value, kind = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(row, kind="stable")
    keys = (value | (kind.astype(np.uint64) << np.uint64(32)))[order].view(np.int64)
    return keys, np.searchsorted(row[order], np.arange(n + 1))


def edit_distance(a: str, b: str, most_wanted: float = float("inf")) -> int:
    """Levenshtein distance by bit-parallel columns in Python's long integers; equal ends are cut off first.

    Once the distance is sure to exceed ``most_wanted``, a number above that is returned.
    """
    start, most = 0, min(len(a), len(b))
    while start < most and a[start] == b[start]:
        start += 1
    end = 0
    while end < most - start and a[-1 - end] == b[-1 - end]:
        end += 1
    a, b = a[start : len(a) - end], b[start : len(b) - end]
    if not a or not b:
        return len(a) + len(b)
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    full, top, plus, minus, distance = (1 << len(a)) - 1, 1 << (len(a) - 1), (1 << len(a)) - 1, 0, len(a)
    for ahead, c in zip(range(len(b) - 1, -1, -1), b):
        match = places.get(c, 0)
        diagonal = (((match & plus) + plus) ^ plus) | match | minus
        up, down = minus | (full & ~(diagonal | plus)), plus & diagonal
        distance += bool(up & top) - bool(down & top)
        if distance - ahead > most_wanted:  # each character ahead takes one away at most
            return distance - ahead
        up, down = (up << 1) | 1, down << 1
        plus, minus = (down | (full & ~(diagonal | up))) & full, up & diagonal & full
    return distance


def edit_similarity(a: str, b: str) -> float:
    """1 - distance / length of the longer; 1 for two empty strings."""
    return 1 - edit_distance(a, b) / max(len(a), len(b), 1)


def similar(a: str, b: str, threshold: float) -> bool:
    most = (1 - threshold) * max(len(a), len(b)) + 1e-9
    return min(len(a), len(b)) >= threshold * max(len(a), len(b)) and edit_distance(a, b, most) <= most


def all_similar(a: list[str], b: list[str], threshold: float) -> np.ndarray:
    """``similar`` of each pair."""
    longer = np.array([max(len(x), len(y)) for x, y in zip(a, b)], np.int64)
    most = (1 - threshold) * longer + 1e-9
    may = np.array([min(len(x), len(y)) for x, y in zip(a, b)], np.int64) >= threshold * longer
    good = np.zeros(len(a), bool)
    for i in np.flatnonzero(may & (longer > LONG_LINE)):
        good[i] = similar(a[i], b[i], threshold)
    rows = np.flatnonzero(may & (longer <= LONG_LINE))
    rows = rows[edits.letters_apart([a[i] for i in rows], [b[i] for i in rows]) <= most[rows]]
    good[rows] = edits.within([a[i] for i in rows], [b[i] for i in rows], most[rows])
    return good


def split_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no, norm) of every line with a letter or digit, of documents with an id."""
    # each text is hashed and normalised once, not once a line; the outer form keeps the optimiser from testing the array's size first, by making it twice
    plain = F.regexp_replace(F.lower("text"), r"[^\p{L}\p{N}\n]+", " ")
    texts = docs.where("doc_id is not null").select("doc_id", F.xxhash64("text").alias("text_hash"), F.split(plain, "\n").alias("parts"))
    lines = texts.select("doc_id", "text_hash", F.posexplode_outer("parts").alias("line_no", "line"))
    return lines.select("doc_id", "text_hash", "line_no", F.trim("line").alias("norm")).where("norm <> ''")


def signed_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, text_hash, line_no, k1, keys) of every line of ``split_lines``: the normalised line's hash, and its block keys where a task meets it first.

    Where a task meets a line again the keys are empty, so a line that is everywhere is one row a task to each of its keys.
    """
    place = ["doc_id", "text_hash", "line_no", "k1"]

    def sign(batches):
        seen: set[int] = set()
        for batch in batches:
            for start, stop in row_chunks(batch["norm"]):
                part = batch.slice(start, stop - start)
                kinds, at = np.unique(part["k1"].to_numpy(), return_index=True)
                new = np.sort(at[[k not in seen for k in kinds.tolist()]])
                if len(seen) > SEEN:
                    seen.clear()  # lines met again are signed again
                seen.update(kinds.tolist())
                keys, firsts = block_keys(part["norm"].take(pa.array(new, pa.int64())))
                sizes = np.zeros(len(part), np.int64)
                sizes[new] = np.diff(firsts)
                lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(sizes)), pa.int32()), pa.array(keys))
                yield pa.RecordBatch.from_arrays([*(part[c] for c in place), lists], [*place, "keys"])

    rows = split_lines(docs).select("doc_id", "text_hash", "line_no", F.xxhash64("norm").alias("k1"), "norm")
    return rows.mapInArrow(sign, "doc_id long, text_hash long, line_no int, k1 long, keys array<long>")


def blocks_of(lines: DataFrame) -> DataFrame:
    """(node, key) of each line's block keys, dealt out by key once for all that asks for it."""
    return lines.select(F.col("k1").alias("node"), F.explode("keys").alias("key")).repartition("key")


def prints(texts: DataFrame) -> DataFrame:
    """(node, size, words, s0, s1, s2) of texts (node, norm): characters, words and SimHash of each."""

    def sign(batches):
        for batch in batches:
            for start, stop in row_chunks(batch["norm"]):
                part = batch.slice(start, stop - start)
                words = word_hashes(*utf8(part["norm"]))
                bits = simhash(*words)
                columns = [part["node"], pc.utf8_length(part["norm"]), pa.array(np.diff(words[1]).astype(np.int32)), *(pa.array(bits[:, k]) for k in range(3))]
                yield pa.RecordBatch.from_arrays(columns, ["node", "size", "words", "s0", "s1", "s2"])

    return texts.select("node", "norm").mapInArrow(sign, "node long, size int, words int, s0 long, s1 long, s2 long")


def screened(pairs: DataFrame, prints: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that lengths and SimHashes let reach the threshold (as ``close_pairs``)."""
    a, b = (prints.select(F.col("node").alias(n), F.struct("size", "words", "s0", "s1", "s2").alias(f"p{n}")) for n in "ab")
    bits = sum((F.bit_count(F.col(f"pa.s{k}").bitwiseXOR(F.col(f"pb.s{k}"))) for k in range(1, 3)), F.bit_count(F.col("pa.s0").bitwiseXOR(F.col("pb.s0"))))
    near = F.least("pa.size", "pb.size") >= threshold * F.greatest("pa.size", "pb.size")
    return pairs.join(a, "a").join(b, "b").where(near & ((F.least("pa.words", "pb.words") < SCREENED_WORDS) | (bits <= FAR_BITS))).select("a", "b")


def joined(labels: np.ndarray, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``labels`` with the labels a[k] and b[k] made one, for all k in order, and the k at which they were still two."""
    root, used = np.arange(int(labels.max()) + 1), []

    def top(i: int) -> int:
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return int(i)

    for k, (i, j) in enumerate(zip(a.tolist(), b.tolist())):
        i, j = top(i), top(j)
        if i != j:
            root[max(i, j)] = min(i, j)
            used.append(k)
    while (root != root[root]).any():
        root = root[root]
    return root[labels], np.array(used, np.int64)


def keys_by_kind(keys: pa.Array) -> np.ndarray:
    """The keys of each row (lists) by kind of block, one column a kind; a kind that a row lacks has a number that no other row has."""
    kinds = 6 + CHAR_BLOCKS + PAIR_BLOCKS
    row, value = np.repeat(np.arange(len(keys)), pc.list_value_length(keys).to_numpy()), keys.flatten().to_numpy()
    out = np.repeat(-1 - np.arange(len(keys))[:, None], kinds, axis=1)
    single = value >> 32 < kinds  # a line has many of what is left without characters
    out[row[single], value[single] >> 32] = value[single]
    return out


def close_pairs(rest: DataFrame, prints: DataFrame, threshold: float, texts: DataFrame | None = None) -> DataFrame:
    """Pairs (a, b), a < b, of nodes of different components that share a key, of which lengths and SimHashes allow the threshold.

    The nodes of a key are cut into blocks by hash, and each pair of blocks is compared in one place. Of lines of
    SCREENED_WORDS words or more the SimHashes must agree in all but FAR_BITS bits: those of lines without common words
    differ in 96 of 192, give or take 7; README gives what similar lines were measured to differ in.

    With ``texts`` (node, norm) the lines are compared in that place too, and the pairs are links that join the same
    components as all links would: a pair that links found there have joined is left out, so are pairs with the key's
    ``hub``, which were compared before, and pairs that meet under an earlier kind of block.
    """
    blocks = rest.groupBy("key").agg(F.ceil(F.count(F.lit(1)) / NODES).alias("blocks"))
    rows = rest.join(blocks, "key").withColumn("mine", F.pmod(F.xxhash64("node"), F.col("blocks")))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    within, more = texts is not None, ["hub", "keys", "norm"] if texts is not None else []
    if within:
        kinds = rest.groupBy("node").agg(F.collect_list("key").alias("keys"))
        prints = kinds.join(prints, "node").join(texts, "node")
    rows = rows.withColumns({"i": F.least("mine", "other"), "j": F.greatest("mine", "other")}).join(prints, "node")
    dealt = rows.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def met(table: pa.Table, starts: np.ndarray, n: int):
        """Pairs within the runs that begin at ``starts``; the last one ends before ``n``."""
        c = {name: table[name].to_numpy() for name in table.column_names if name not in ("keys", "norm")}
        bits = np.stack([c[f"s{k}"].view(np.uint64) for k in range(3)], 1)
        counts = np.repeat(np.append(starts[1:], n), np.diff(np.append(starts, n))) - np.arange(n) - 1
        labels = np.unique(c["comp"], return_inverse=True)[1]
        upto, first = np.cumsum(counts), 0
        while first < n:
            base = int(upto[first] - counts[first])
            stop = max(first + 1, int(np.searchsorted(upto, base + PAIRS, "right")))
            x = np.repeat(np.arange(first, stop), counts[first:stop])
            y = x + 1 + np.arange(len(x)) - np.repeat(upto[first:stop] - counts[first:stop] - base, counts[first:stop])
            most = np.maximum(c["size"][x], c["size"][y])
            near = (labels[x] != labels[y]) & (np.minimum(c["size"][x], c["size"][y]) >= threshold * most)
            near &= (c["i"][x] == c["j"][x]) | (c["mine"][x] != c["mine"][y])
            x, y = x[near], y[near]
            far = np.bitwise_count(bits[x] ^ bits[y]).sum(1)
            near = (np.minimum(c["words"][x], c["words"][y]) < SCREENED_WORDS) | (far <= FAR_BITS)
            if within:
                near &= (c["node"][x] != c["hub"][x]) & (c["node"][y] != c["hub"][y])
            x, y, far = x[near], y[near], far[near]
            if within and len(x):
                x, y, labels = linked(table, c["key"], labels, x, y, far)
            a, b = c["node"][x], c["node"][y]
            yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])
            first = stop

    def linked(table: pa.Table, key: np.ndarray, labels: np.ndarray, x: np.ndarray, y: np.ndarray, far: np.ndarray):
        """Links among the pairs (x, y), and the labels that they leave; the likeliest pairs are compared first."""
        rows = np.unique(np.append(x, y))
        kinds, norm = keys_by_kind(table["keys"].take(pa.array(rows)).combine_chunks()), table["norm"].combine_chunks()
        new = np.empty(len(x), bool)
        for start in range(0, len(x), TOGETHER):
            u, v = x[start : start + TOGETHER], y[start : start + TOGETHER]
            same = kinds[np.searchsorted(rows, u)] == kinds[np.searchsorted(rows, v)]
            new[start : start + TOGETHER] = ~(same & (np.arange(kinds.shape[1]) < (key[u] >> 32)[:, None])).any(1)
        order = np.flatnonzero(new)[np.argsort(far[new], kind="stable")]
        x, y, found, size = x[order], y[order], [], 256
        while len(x):
            good = alike(norm.take(pa.array(x[:size])), norm.take(pa.array(y[:size])), threshold)
            u, v = x[:size][good], y[:size][good]
            labels, used = joined(labels, labels[u], labels[v])
            found.append((u[used], v[used]))
            x, y = x[size:], y[size:]
            apart = labels[x] != labels[y]
            x, y, size = x[apart], y[apart], min(2 * size, TOGETHER)
        return *(np.concatenate([pair[k] for pair in found] or [np.zeros(0, np.int64)]) for k in (0, 1)), labels

    def compare(batches):
        kept = None
        for batch in batches:
            table = pa.Table.from_batches([batch] if kept is None else [*kept.to_batches(), batch])
            place = np.stack([table[name].to_numpy() for name in ("key", "i", "j")])
            starts = np.append(0, np.flatnonzero((place[:, 1:] != place[:, :-1]).any(0)) + 1)
            if len(starts) > 1:
                yield from met(table, starts[:-1], int(starts[-1]))
            kept = table.slice(int(starts[-1])).combine_chunks()  # the last run may go on
        if kept is not None and len(kept):
            yield from met(kept, np.zeros(1, np.int64), len(kept))

    return dealt.select("key", "i", "j", "mine", "comp", "node", "size", "words", "s0", "s1", "s2", *more).mapInArrow(compare, "a long, b long")


def alike(a: pa.Array, b: pa.Array, threshold: float) -> np.ndarray:
    """``all_similar`` of two columns, a few MB at once."""
    good = [all_similar(a[start:stop].to_pylist(), b[start:stop].to_pylist(), threshold) for start, stop in row_chunks(a)]
    return np.concatenate(good or [np.zeros(0, bool)])


def verified(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) of nodes whose lines reach the edit similarity."""

    def check(batches):
        for batch in batches:
            yield batch.select(["a", "b"]).filter(pa.array(alike(batch["ta"], batch["tb"], threshold)))

    return pairs.join(texts.toDF("a", "ta"), "a").join(texts.toDF("b", "tb"), "b").select("a", "b", "ta", "tb").mapInArrow(check, "a long, b long")


def line_classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """One row (doc_id, text_hash, line_no, class_doc, class_line, kept) per line with a letter or digit.

    Lines are compared as lower-cased runs of letters and digits. Lines that share a block (``block_keys``) and
    whose edit similarity is ``threshold`` or more are linked. Blocks are six of the SimHash's 192 bits (lines
    within 5 bits share one), MinHash registers of five-byte grams or word pairs, and for lines of at most 14
    characters what is left without one or two of them; README gives the share of links that they find. A class
    is a connected component, named by its first occurrence (smallest doc_id, then hash of the text, then line
    number), which alone is kept. Lines of one normalised form (by its 64-bit hash) are one node of the graph.

    Lines without a letter or digit, lines of a null text and of documents without an id have no row: they
    are left alone. Different texts under one doc_id are told apart by text_hash (xxhash64 of the text); rows that
    repeat a doc_id and its text keep the same lines. Runs its jobs when called.
    """
    spark, docs = docs.sparkSession, docs.select("doc_id", "text")
    with arrow_rows(spark, 5000):
        lines = materialize(signed_lines(docs), "lines")
    # each normalised line once, with its first place: partial minima go through the shuffle, so a very common line is a few rows
    kinds = materialize(lines.groupBy("k1").agg(F.min(F.struct("doc_id", "text_hash", "line_no")).alias("at"), F.count(F.lit(1)).alias("n")), "line-kinds")
    shared = linking.shared_keys(blocks_of(lines))
    wanted = materialize(kinds.join(shared.select(F.col("node").alias("k1")).distinct(), "k1").select(F.col("k1").alias("node"), "at.doc_id", "at.line_no"), "line-places")
    asked = materialize(wanted.groupBy("doc_id").agg(F.collect_set("line_no").alias("asked")), "asked-lines")
    found = docs.select("doc_id", "text").join(join_side(asked, "asked"), "doc_id").select(F.split("text", "\n").alias("lines"), "asked").select(F.explode(F.transform("asked", lambda i: F.get("lines", i))).alias("line"))
    norm = found.select(normalized(F.col("line")).alias("norm")).select(F.xxhash64("norm").alias("node"), "norm")
    texts = materialize(norm.join(wanted.select("node"), "node", "left_semi").dropDuplicates(["node"]), "line-texts")

    def verify(pairs: DataFrame) -> DataFrame:
        with arrow_rows(spark, 2000):
            return materialize(verified(pairs, texts, threshold), "line-edges")

    with arrow_rows(spark, 5000):
        signed = materialize(prints(texts), "line-prints")

    def pair_up(rest: DataFrame) -> DataFrame:
        with arrow_rows(spark, 2000):
            return materialize(close_pairs(rest, signed, threshold, texts), "rest-edges")

    comp = linking.link(shared, verify, pair_up, lambda pairs: screened(pairs, signed, threshold), linked=True)
    # only lines that have a copy or a link need to be looked up
    touched = materialize(kinds.join(comp.toDF("k1", "comp"), "k1", "left").where("n > 1 or comp is not null").select("k1", "at", F.coalesce("comp", "k1").alias("comp")), "touched-lines")
    firsts = touched.groupBy("comp").agg(F.min("at").alias("first"))
    classes = materialize(touched.join(firsts, "comp").select("k1", F.col("first.doc_id").alias("class_doc"), F.col("first.text_hash").alias("class_text"), F.col("first.line_no").alias("class_line")), "line-classes")
    out = lines.select("doc_id", "text_hash", "line_no", "k1").join(join_side(classes), "k1", "left")
    first = (F.col("doc_id") == F.col("class_doc")) & (F.col("text_hash") == F.col("class_text")) & (F.col("line_no") == F.col("class_line"))
    kept = F.col("class_doc").isNull() | first
    return out.select("doc_id", "text_hash", "line_no", F.coalesce("class_doc", "doc_id").alias("class_doc"), F.coalesce("class_line", "line_no").alias("class_line"), kept.alias("kept"))


def drop_lines(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """``docs`` without the lines that ``classes`` does not keep; a document that loses all its worded lines goes.

    Documents that had no worded line stay as they are, so do those without an id. The order of the lines that stay
    is the text's own. Lines are found by doc_id and hash of the text, so texts that share an id lose their own only.
    """
    drop = materialize(classes.where("not kept").groupBy(F.col("doc_id").alias("_drop_id"), F.col("text_hash").alias("_drop_text")).agg(F.collect_set("line_no").alias("_drop_lines")), "drop-lines")
    joined = docs.join(join_side(drop, "_drop_lines"), (F.col("doc_id") == F.col("_drop_id")) & (F.xxhash64("text") == F.col("_drop_text")), "left")
    left = F.array_join(F.filter(F.split("text", "\n"), lambda x, i: ~F.array_contains("_drop_lines", i)), "\n")
    cleaned = joined.withColumn("text", F.when(F.col("_drop_lines").isNull(), F.col("text")).otherwise(left))
    return cleaned.where(F.col("_drop_lines").isNull() | F.col("text").rlike(r"[\p{L}\p{N}]")).select(docs.columns)
