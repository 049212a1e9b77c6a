"""Stupid-backoff language-model scores of documents.

Documents are dealt into blocks by hash. Each block explodes its texts into word
n-grams and adds them up; the sums meet in count tables partitioned by n-gram hash,
where equal n-grams of all blocks are joined. The totals go back to the blocks that
asked and are joined to their n-grams, and scores are summed per document. A block
sends every n-gram once however often it occurs, so no n-gram is a hot key. What
blocks send is packed: sorted hashes as differences, counts compressed.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import ragged

ORDER = 2
BACKOFF = 0.4
BLOCK_BYTES = 24 << 20  # text of one block
U64 = ragged.U64

_REQUEST = "block int, bucket int, grams binary, counts binary"
_TOTALS = "block int, bucket int, totals binary"
_SCORES = "_id {kind}, n_tokens bigint, log_score double, n_backed_off bigint"


def _grams_of(texts: pa.Array, order: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For every order: n-gram hashes, last words' positions and rows of a column of texts."""
    words, offsets = ragged.hashed_words(texts)
    out = []
    for n in range(1, order + 1):
        g, at, row = ragged.grams(words, offsets, n)
        out.append((g, at + n - 1, row))
    return out


def _block_counts(texts: pa.Array, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of all orders, sorted, and their counts."""
    tables: list[tuple[np.ndarray, np.ndarray]] = []
    for part in ragged.slices(texts):
        tables.append(np.unique(np.concatenate([g for g, _, _ in _grams_of(part, order)]), return_counts=True))
        while len(tables) > 1 and len(tables[-2][0]) <= 2 * len(tables[-1][0]):  # tables of like size meet
            tables[-2:] = [_added(*tables[-2], *tables[-1])]
    while len(tables) > 1:
        tables[-2:] = [_added(*tables[-2], *tables[-1])]
    return tables[0] if tables else (np.empty(0, U64), np.empty(0, np.int64))


def _requests(order: int, buckets: int) -> object:
    """Distinct n-grams of a block and their counts, one row per bucket of the hash range."""

    def run(table: pa.Table) -> pa.Table:
        block = table["_block"][0].as_py()
        grams, counts = _block_counts(table["_text"].combine_chunks(), order)
        cuts = np.searchsorted(_bucket(grams, buckets), np.arange(buckets + 1))
        full = np.flatnonzero(np.diff(cuts))
        return pa.table({
            "block": pa.array(np.full(len(full), block, np.int32)), "bucket": pa.array(full.astype(np.int32)),
            "grams": pa.array([_coded(grams[cuts[b]:cuts[b + 1]]) for b in full], pa.binary()),
            "counts": pa.array([_pressed(_packed(counts[cuts[b]:cuts[b + 1]])) for b in full], pa.binary())})

    return run


def _added(a: np.ndarray, n: np.ndarray, b: np.ndarray, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sum of two sorted count tables."""
    if not len(a):
        return b, m
    slot = np.minimum(np.searchsorted(a, b), len(a) - 1)
    old = a[slot] == b
    n[slot[old]] += m[old]
    at = np.searchsorted(a, b[~old])
    return np.insert(a, at, b[~old]), np.insert(n, at, m[~old])


def _bucket(grams: np.ndarray, buckets: int) -> np.ndarray:
    """Equal ranges of the hash, in its order."""
    return ((grams >> U64(32)) * U64(buckets) >> U64(32)).astype(np.int64)


def _packed(values: np.ndarray) -> bytes:
    """Counts as bytes, those above 254 as 255 with the full numbers behind."""
    small = np.minimum(values, 255).astype(np.uint8)
    return small.tobytes() + values[small == 255].astype(np.uint64).tobytes()


def _unpacked(data: bytes, n: int) -> np.ndarray:
    small = np.frombuffer(data, np.uint8, n)
    out = small.astype(np.int64)
    out[small == 255] = np.frombuffer(data, np.uint64, -1, n).astype(np.int64)
    return out


def _pressed(data: bytes) -> bytes:
    return len(data).to_bytes(8, "little") + pa.compress(data, "zstd", asbytes=True)


def _unpressed(data: bytes) -> bytes:
    return pa.decompress(data[8:], int.from_bytes(data[:8], "little"), "zstd", asbytes=True)


def _coded(grams: np.ndarray) -> bytes:
    """Sorted hashes as differences, byte by byte: five low bytes as they are, the high ones compressed."""
    planes = np.diff(grams, prepend=U64(0)).astype("<u8").view(np.uint8).reshape(-1, 8).T
    return len(grams).to_bytes(8, "little") + planes[:5].tobytes() + _pressed(planes[5:].tobytes())


def _decoded(data: bytes) -> np.ndarray:
    at = 8 + 5 * int.from_bytes(data[:8], "little")
    planes = np.frombuffer(data[8:at] + _unpressed(data[at:]), np.uint8).reshape(8, -1)
    return np.cumsum(np.ascontiguousarray(planes.T).view("<u8").reshape(-1), dtype=U64)


def _totals(table: pa.Table) -> pa.Table:
    """Joins the n-grams of one bucket over all blocks and answers every block with the totals of its own.

    Totals come in the order of the block's n-grams, which the block knows.
    """
    rows = [_decoded(g) for g in table["grams"].to_pylist()]
    counts = [_unpacked(_unpressed(c), len(g)) for g, c in zip(rows, table["counts"].to_pylist())]
    known, slot = np.unique(np.concatenate(rows), return_inverse=True)
    total = np.bincount(slot, np.concatenate(counts), len(known)).astype(np.int64)
    answer, at = [], 0
    for g in rows:
        answer.append(_pressed(_packed(total[slot[at:at + len(g)]])))
        at += len(g)
    return pa.table({"block": table["block"], "bucket": table["bucket"], "totals": pa.array(answer, pa.binary())})


def _slice_scores(
    texts: pa.Array, known: np.ndarray, total: np.ndarray, order: int, backoff: float, whole: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words, score and words backed off of every text, given the totals of its n-grams."""
    n = len(texts)
    found = _grams_of(texts, order)
    words, row = len(found[0][0]), found[0][2]
    tokens = np.bincount(row, minlength=n)
    left = np.maximum(whole - tokens, 1)[row]
    best, used, shorter = np.zeros(words), np.ones(words, np.int64), np.zeros(words, np.int64)
    for k, (grams, last, rows) in enumerate(found):
        by_hash = np.argsort(grams)
        slot = np.empty(len(grams), np.int64)
        slot[by_hash] = np.searchsorted(known, grams[by_hash])
        pair = by_hash[np.argsort(rows[by_hash], kind="stable")]
        s, r = slot[pair], rows[pair]
        cut = np.flatnonzero(np.concatenate(([True], (s[1:] != s[:-1]) | (r[1:] != r[:-1])))) if len(s) else pair
        times = np.diff(np.append(cut, len(grams)))
        own = np.empty(len(grams), np.int64)
        own[pair] = np.repeat(times, times)
        others = np.zeros(words, np.int64)  # count in the other documents, at the n-gram's last word
        others[last] = total[slot] - own
        if k == 0:  # a word that no other document has counts as half a word
            best = np.log(np.where(others > 0, others, 0.5) / left)
        else:
            context = np.zeros(words, np.int64)
            context[last] = shorter[last - 1]
            possible = np.zeros(words, bool)
            possible[last] = True
            seen = possible & (others > 0) & (context > 0)
            ratio = np.log(np.maximum(others, 1) / np.maximum(context, 1))
            best = np.where(seen, ratio, np.where(possible, math.log(backoff) + best, best))
            used[seen] = k + 1
        shorter = others
    place = np.arange(words) - np.concatenate(([0], np.cumsum(tokens)))[row]
    backed = np.bincount(row, used < np.minimum(place + 1, order), n)
    return tokens, np.bincount(row, best, n), backed


def _scores(order: int, backoff: float, whole: int, buckets: int, schema: pa.Schema) -> object:
    def run(docs: pa.Table, answers: pa.Table) -> pa.Table:
        if not len(docs):
            return schema.empty_table()
        texts = docs["_text"].combine_chunks()
        known, _ = _block_counts(texts, order)
        sizes = np.bincount(_bucket(known, buckets), minlength=buckets)
        parts = sorted(zip(answers["bucket"].to_pylist(), answers["totals"].to_pylist()))
        total = np.concatenate([np.empty(0, np.int64), *(_unpacked(_unpressed(t), sizes[b]) for b, t in parts)])
        done = [
            _slice_scores(part, known, total, order, backoff, whole)
            for part in ragged.slices(texts)]
        tokens, sums, backed = (np.concatenate(x) for x in zip(*done))
        return pa.table([
            docs["_id"], pa.array(tokens.astype(np.int64)), pa.array(sums), pa.array(backed.astype(np.int64))],
            schema=schema)

    return run


def score(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: int = ORDER, backoff: float = BACKOFF,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`id_col`, `n_tokens`, `log_score`, `mean_log_score`, `n_backed_off`: one row per document.

    The model of a document is the counts of all other rows, every text whole. A
    word's score is the count of the longest n-gram that others have over that of
    its context, times `backoff` for each order given up; words that no other row
    has count as half an occurrence among the other rows' words. `log_score` sums
    natural logarithms, `n_backed_off` counts words scored below the order their
    place allows. Words are those of `ragged`. Texts that are null, empty or wordless
    have no tokens, the score 0 and a null mean. Repeated rows are documents of their
    own and see each other. `block_bytes` of text fit a task several times; blocks send
    each other one row per pair of block and bucket, so it should grow with the memory
    of the executors. An empty table gives an empty one; other columns are not read.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    whole_text = F.coalesce(F.col(text_col), F.lit(""))
    size = docs.agg(F.sum(F.octet_length(text_col).cast("bigint")).alias("s")).first()["s"] or 0
    blocks = max(1, math.ceil(size / block_bytes))
    own = docs.select(F.col(id_col).alias("_id"), whole_text.alias("_text"))
    dealt = own.withColumn("_block", F.pmod(F.xxhash64("_id", "_text"), F.lit(blocks)).cast("int"))
    buckets = math.ceil(blocks * max(order, 2) / 2)  # a bucket's n-grams do not grow with the order
    requests = dealt.groupBy("_block").applyInArrow(_requests(order, buckets), _REQUEST)
    answers = requests.groupBy("bucket").applyInArrow(
        _totals, _TOTALS)
    kind = dealt.schema["_id"].dataType
    schema = pa.schema([
        ("_id", to_arrow_type(kind)), ("n_tokens", pa.int64()), ("log_score", pa.float64()), ("n_backed_off", pa.int64())])
    whole = words_of(docs, text_col)
    scored = dealt.groupBy("_block").cogroup(answers.groupBy("block")).applyInArrow(
        _scores(order, backoff, whole, buckets, schema), _SCORES.format(kind=kind.simpleString()))
    return scored.select(
        F.col("_id").alias(id_col), "n_tokens", "log_score",
        F.when(F.col("n_tokens") > 0, F.col("log_score") / F.col("n_tokens")).alias("mean_log_score"), "n_backed_off")


def words_of(docs: DataFrame, text_col: str) -> int:
    """Words of all texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = 0
        for batch in batches:
            for part in ragged.slices(batch["t"]):
                n += len(ragged.word_spans(*ragged.text_bytes(part))[0])
        yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64())], ["n"])

    return docs.select(F.col(text_col).alias("t")).mapInArrow(run, "n bigint").agg(F.sum("n").alias("n")).first()["n"] or 0
