"""Best-fit packing of tokenised documents by bin completion.

A document's ids and an end mark make its line; only lines longer than a sequence are cut, the first
piece taking the remainder. Which lengths share a sequence is decided on the histogram of piece
lengths, which has at most ``LENGTH`` rows whatever the data: around the largest remaining piece the
undominated fillings are enumerated, a filling is used as often as its lengths last, branches whose
waste already rules out an improvement are pruned, and the best-fit solution is the first
incumbent. Pieces are then numbered within their length (in chunks of bounded size, so one length
may hold any share of the rows) and meet the plan by length and number.

Defined cases: a null text is an empty document of one token, the end mark; repeated rows are packed
separately; null ids are kept; an empty table gives no rows; further columns are ignored. Texts are
tokenised whole.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from linkforge.llm.arrow import map_arrow
from linkforge.runtime import cut

LENGTH = 1024
END = 2
NODES = 4000
WIDTH = 6
#: Pieces of one length that are numbered together.
CHUNK = 512


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[str, int]:
    """Letters that byte-level vocabularies write for bytes: printable bytes as they are, the rest from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    """Ids of a whole text by the tokenizer file at ``path``.

    A byte-level BPE whose ids follow its merges is run by tiktoken, which gives the same ids several
    times faster; any other file is run by tokenizers.
    """
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    vocab = model.get("vocab", {})
    merges = [m if isinstance(m, str) else " ".join(m) for m in model.get("merges", [])]
    in_order = all(vocab.get(m.replace(" ", "", 1)) == 256 + i for i, m in enumerate(merges)) if model.get("type") == "BPE" else False
    byte_level = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True)
    if in_order and byte_level and spec.get("normalizer") is None and not model.get("continuing_subword_prefix") and not model.get("end_of_word_suffix"):
        import public_tokenizers
        import tiktoken

        letters = _byte_letters()
        special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocab.items() if token not in special}
        own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens=special)
        return lambda text: own.encode_to_numpy(text, allowed_special="all")
    from tokenizers import Tokenizer

    slow = Tokenizer.from_file(path)
    return lambda text: np.array(slow.encode(text, add_special_tokens=False).ids, np.uint32)


def pieces(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32[, ids]): every document's pieces."""
    path = tokenizer or default_tokenizer()
    kind = docs.schema[doc_id].dataType.simpleString()
    names = ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * keep_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(path)
        for batch in batches:
            rows: list[tuple] = []
            at_row, ids_of = [], []
            for i, t in enumerate(batch.column(1)):
                ids = np.append(encode(t.as_py() or ""), np.uint32(end)).astype("<u4")
                stops = [*range(len(ids) % length or length, len(ids), length), len(ids)] if len(ids) > length else [len(ids)]
                start = 0
                for n, stop in enumerate(stops):
                    rows.append((n, start, stop - start, zlib.crc32(ids[start:stop].tobytes())))
                    at_row.append(i)
                    if keep_ids:
                        ids_of.append(ids[start:stop])
                    start = stop
            cols = [pa.array([r[c] for r in rows], k) for c, k in enumerate((pa.int32(), pa.int64(), pa.int64(), pa.int64()))]
            out = [batch.column(0).take(pa.array(at_row, pa.int64())), *cols]
            if keep_ids:
                out.append(pa.array(ids_of, pa.list_(pa.int64())))
            yield pa.RecordBatch.from_arrays(out, names=names)

    schema = f"doc_id {kind}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids
    return map_arrow(docs.select(doc_id, text), run, schema)


# --- the plan, on the histogram of lengths ---------------------------------------------------


def lower_bound(counts: np.ndarray, cap: int) -> int:
    """Sequences that any packing needs: by total length, or by pieces that cannot share."""
    sizes = np.arange(len(counts))
    total = int((counts * sizes).sum())
    best = -(-total // cap)
    number, weight = np.cumsum(counts), np.cumsum(counts * sizes)
    half = cap // 2
    for k in range(0, half + 1):
        alone = int(number[cap] - number[cap - k])
        large = int(number[cap - k] - number[half])
        room = large * cap - int(weight[cap - k] - weight[half])
        small = int(weight[half] - (weight[k - 1] if k else 0))
        best = max(best, alone + large + max(0, -(-(small - room) // cap)))
    return best


def _dominates(a: tuple[int, ...], b: tuple[int, ...]) -> bool:
    """Whether the pieces of filling ``b`` fit, in groups, into the places of the pieces of ``a``."""

    def place(room: list[int], rest: tuple[int, ...]) -> bool:
        if not rest:
            return True
        for i, r in enumerate(room):
            if r >= rest[0] and (i == 0 or room[i - 1] != r):
                room[i] -= rest[0]
                if place(room, rest[1:]):
                    room[i] += rest[0]
                    return True
                room[i] += rest[0]
        return False

    return sum(a) >= sum(b) and place(list(a), b)


def fillings(counts: np.ndarray, room: int, width: int = WIDTH) -> list[tuple[int, ...]]:
    """Undominated ways to fill ``room`` with up to four lengths, the fullest first, then the largest."""
    have = np.flatnonzero(counts[: room + 1] > 0)
    if not len(have):
        return [()]
    below = np.zeros(room + 1, np.int64)  # the largest length there is up to a size
    below[have] = have
    below = np.maximum.accumulate(below)
    found: set[tuple[int, ...]] = set()

    def best_two(first: int, rest: int, most: int) -> tuple[np.ndarray, np.ndarray]:
        x = have[(have <= min(first, rest))][::-1][:most]
        y = below[np.minimum(x, rest - x)]
        return x, y

    def add(items: tuple[int, ...]) -> None:
        items = tuple(int(i) for i in items if i)
        if all(counts[i] >= items.count(i) for i in set(items)):
            left = room - sum(items)
            while left > 0 and len(items) < 64 and (i := int(below[min(left, items[-1] if items else left)])):  # complete it greedily
                while i and counts[i] <= items.count(i):
                    i = int(below[i - 1])
                if not i:
                    break
                items = (*items, i)
                left -= i
            found.add(items)

    add((have[-1],))
    x, y = best_two(room, room, 1024)
    order = np.argsort(-(x + y), kind="stable")[: 2 * width]
    for i in order.tolist():
        add((x[i], y[i]))
    for first in have[::-1][: 2 * width].tolist():
        u, v = best_two(first, room - first, 256)
        if len(u):
            for i in np.argsort(-(u + v), kind="stable")[:2].tolist():
                add((first, u[i], v[i]))
    ranked = sorted(found, key=lambda f: (-sum(f), len(f), tuple(-i for i in f)))
    kept: list[tuple[int, ...]] = []
    for f in ranked:
        if not any(_dominates(k, f) for k in kept if len(k) <= 6 and len(f) <= 6):
            kept.append(f)
            if len(kept) == width:
                break
    return kept


Plan = list[tuple[tuple[int, ...], int]]


def _use(counts: np.ndarray, pattern: tuple[int, ...]) -> int:
    """Take a pattern out of the counts as often as its lengths last."""
    times = min(int(counts[i]) // pattern.count(i) for i in set(pattern))
    for i in pattern:
        counts[i] -= times
    return times


def best_fit(counts: np.ndarray, cap: int) -> Plan:
    """The incumbent: each sequence is begun by the largest piece and filled with the largest that fits."""
    counts, plan = counts.copy(), []
    while len(have := np.flatnonzero(counts)):
        pattern = [int(have[-1])]
        room, upto = cap - pattern[0], len(have) - 1
        while upto >= 0 and room > 0:
            i = int(have[upto])
            if i > room or counts[i] <= pattern.count(i):
                upto = min(upto - 1, int(np.searchsorted(have, room, "right")) - 1)
                continue
            pattern.append(i)
            room -= i
        plan.append((tuple(pattern), _use(counts, tuple(pattern))))
    return plan


def complete(counts: np.ndarray, cap: int = LENGTH, nodes: int = NODES) -> Plan:
    """Patterns of lengths and how often each is used, covering ``counts[length]`` pieces."""
    counts = np.asarray(counts, np.int64)
    best = best_fit(counts, cap)
    used = sum(t for _, t in best)
    bound = lower_bound(counts, cap)
    total = int((counts * np.arange(len(counts))).sum())
    budget = nodes

    def search(counts: np.ndarray, plan: Plan, bins: int, waste: int) -> None:
        nonlocal best, used, budget
        stack = [(counts, plan, bins, waste)]
        while stack and budget > 0 and used > bound:
            counts, plan, bins, waste = stack.pop()
            have = np.flatnonzero(counts)
            if not len(have):
                if bins < used:
                    best, used = plan, bins
                continue
            budget -= 1
            top = int(have[-1])
            counts[top] -= 1
            ways = fillings(counts, cap - top)
            counts[top] += 1
            for f in reversed(ways):
                left = counts.copy()
                times = _use(left, (top, *f))
                lost = waste + times * (cap - top - sum(f))
                if lost > (used - 1) * cap - total or bins + times >= used:
                    continue  # too much waste for an improvement
                stack.append((left, [*plan, ((top, *f), times)], bins + times, lost))

    search(counts.copy(), [], 0, 0)
    return best


def pack(docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, doc_id: str = "doc_id", text: str = "text", keep_ids: bool = False) -> DataFrame:
    """Every piece with its sequence and place there: pieces' columns, sequence_id and offset."""
    spark = docs.sparkSession
    cuts = cut(pieces(docs, tokenizer, length, end, doc_id, text, keep_ids), "pieces")
    histogram = cuts.groupBy("length").count().collect()  # at most ``length`` rows
    counts = np.zeros(length + 1, np.int64)
    for r in histogram:
        counts[r["length"]] = r["count"]
    rows, taken, sequence = [], [0] * (length + 1), 0
    for pattern, times in complete(counts, length):
        at = 0
        for i in pattern:
            rows.append((i, taken[i], taken[i] + times, sequence - taken[i], at))
            taken[i] += times
            at += i
        sequence += times
    chunks = F.get(F.lit([max(1, -(-int(c) // CHUNK)) for c in counts]), F.col("length").cast("int"))
    own = cuts.withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), chunks))
    firsts = own.groupBy("length", "chunk").count()
    firsts = firsts.withColumn("first", F.sum("count").over(Window.partitionBy("length").orderBy("chunk")) - F.col("count")).drop("count")
    rank = F.row_number().over(Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32", "start")) - 1
    ranked = own.withColumn("r", rank).join(firsts, ["length", "chunk"]).withColumn("rank", F.col("first") + F.col("r"))
    # Bounded by the sequence length: each pattern uses up a length or leaves less of it than one more use needs.
    plan = F.broadcast(spark.createDataFrame(rows, "of long, low long, high long, shift long, offset long"))
    out = ranked.join(plan, (F.col("length") == F.col("of")) & (F.col("rank") >= F.col("low")) & (F.col("rank") < F.col("high")))
    return out.select(*cuts.columns, (F.col("rank") + F.col("shift")).alias("sequence_id"), "offset")


def query(spark, sf_dir: str) -> DataFrame:
    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
